"""Edge cases of functions and operators on planted rows."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.functions import dates, ids, stats, text
from weirflow.operators import finance, funnel, quality, risk, sampling, trend
from weirflow.sources import readers
from weirflow.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def over(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10), (11, 10), (-1, 10)], "k long, n long")
    got = rows.select(stats.wilson_low(F.col("k"), F.col("n")).alias("a"), stats.wilson_high(F.col("k"), F.col("n")).alias("b")).collect()
    assert got[0].a is None and got[4].a is None and got[5].b is None
    assert got[1].a == 0.0 and got[2].b == pytest.approx(1.0)
    assert got[3].a == pytest.approx(0.2366, abs=1e-4) and got[3].b == pytest.approx(0.7634, abs=1e-4)


def test_tails():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965034965, abs=1e-9)


def test_predicates(spark):
    values = [None, "", "  ", "[deleted]", " [Removed]\n", "NaN", "http://a.b/c", "http://a.b see", "Lorem Ipsum", "سلام"]
    assert over(spark, values, text.is_present) == [False, False, False, True, True, True, True, True, True, True]
    assert over(spark, values, text.is_empty_text) == [True, True, True, True, True, True, False, False, False, False]
    assert over(spark, values, text.is_url_only) == [False] * 6 + [True, False, False, False]
    assert over(spark, values, text.is_synthetic) == [False] * 8 + [True, False]


def test_entities_and_masking(spark):
    t = "a@b.co call +98 (21) 1234-5678 #تگ x#no @me e@no.com ☀☀"
    row = spark.createDataFrame([(t,)], "t string").select(*[c.alias(n) for n, c in text.entities(F.col("t")).items()], *[c.alias(n) for n, c in zip(("m", "f"), text.mask_pii(F.col("t")), strict=True)]).first()
    assert row.hashtags_extracted == "#تگ" and row.mentions_extracted == "@me" and row.emojis_extracted == "☀"
    assert row.f and "[EMAIL]" in row.m and "[PHONE]" in row.m and "a@b.co" not in row.m
    assert over(spark, ["café​  x\t y\n"], lambda c: text.tidy(text.nfc(c))) == ["café x y"]


def test_numbers_and_ids(spark):
    assert over(spark, ["1.2K", "3M", "1,234", "2b", "12 likes", "", None, "x"], text.compact_number) == [1200, 3_000_000, 1234, 2_000_000_000, 12, None, None, None]
    assert over(spark, ["Q2;Q1, Q2|Q3", None, ""], text.split_ids) == [["Q1", "Q2", "Q3"], [], []]
    assert over(spark, [None, " ", "u"], lambda c: ids.author_hash(F.lit("x"), c, "s"))[:2] == [None, None]
    import zlib

    assert over(spark, ["abc", "ü"], lambda c: ids.shard(c, 7)) == [zlib.crc32(x.encode()) % 7 for x in ("abc", "ü")]


def test_dates(spark):
    assert over(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.1Z", "x", None], lambda c: dates.strict_utc(c).isNotNull()) == [True, False, False, False]
    assert over(spark, ["1704067200", "1704067200000", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "", "12"], lambda c: dates.epoch_or_iso(c)[1]) == ["epoch_seconds", "epoch_millis", "iso", "unparseable", "missing", "unparseable"]


def test_calendar(spark):
    moments = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00", "2024-01-30 23:59:59", "2024-01-31 00:00:00", None]
    assert over(spark, moments, lambda c: PROJECT.week(c.cast("timestamp"))) == ["OUT", "W01", "W01", "W02", "W05", "OUT", "OUT"]
    assert PROJECT.partial == "W05" and len(PROJECT.labels) == 5
    whole = ProjectCalendar(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 14, 23, 59, 59, tzinfo=UTC))
    assert whole.partial is None and whole.labels == ["W01", "W02"]


def test_trend_has_gaps_and_zero_counts(spark):
    rows = spark.createDataFrame([("x", "W01", "ok", "positive"), ("x", "W01", "ok", None), ("x", "W02", "api_failure", "positive")], "platform string, project_week string, annotation_status string, sentiment_label string")
    out = {(r.platform, r.project_week, r.class_label): r for r in trend.class_trend(rows, "sentiment_label", ("positive", "negative")).collect()}
    assert len(out) == 3 * 5 * 2
    first = out["x", "W01", "positive"]
    assert (first.n, first.class_count, first.class_proportion, first.is_low_sample) == (2, 1, 0.5, True)
    assert out["x", "W02", "positive"].is_data_gap and out["x", "W02", "positive"].class_proportion is None


def test_dedup_keeps_earliest_and_merges(spark):
    rows = spark.createDataFrame([("x", "1", "r1", "2024-02-02", 2, "Q2"), ("x", "1", "r2", "2024-02-01", 3, "Q1;Q3"), ("x", None, "r3", None, None, None)], "platform string, platform_content_id string, record_uid string, collected_at string, original_row_number int, matched_query_ids string")
    out = {r.record_uid: r for r in funnel.keep_earliest(rows).collect()}
    assert out["r1"].is_duplicate_id and not out["r2"].is_duplicate_id and not out["r3"].is_duplicate_id
    assert out["r2"].merged_query_ids == "Q1;Q2;Q3"


def test_comment_risk(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(k, None, "a", at(k * 10), "same") for k in range(5)] + [(9, "p", None, None, "http://a #b #c http://d")]
    out = {r.content_id: r for r in risk.comment_risk(spark.createDataFrame(rows, "content_id long, batch string, author string, ts timestamp, text string")).collect()}
    assert out[4].duplicate_score == 1.0 and out[4].burst_score == pytest.approx(2 / 3) and out[0].burst_score == 0.0
    assert out[9].link_score == 1.0 and out[9].burst_score == 0.0


def test_empty_frames(spark):
    none = spark.createDataFrame([], "content_id long, batch string, author string, ts timestamp, text string")
    assert risk.comment_risk(none).count() == 0
    assert finance.changes(spark.createDataFrame([], "observation_date date, asset_id string, value double")).count() == 0
    assert sampling.stratified_cap(none, "content_id", ("author",), 3).count() == 0


def test_funnel_reconciles(spark):
    from weirflow.plans.texts import raw_records

    raw = raw_records(spark, "/root/testdata/sf0.001")
    decided = funnel.decide(raw)
    funnel.check_reconciled(raw.count(), decided)
    with pytest.raises(ValueError):
        funnel.check_reconciled(raw.count() + 1, decided)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a", "extra": 2}\n\n{bad\n{"id": 2}\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id long, x string")
    assert sorted((r.id, r.x) for r in good.collect()) == [(1, "a"), (2, None)] and bad.count() == 1
    (tmp_path / "b.csv").write_text("﻿name,text\nx,\n", encoding="utf-8")
    assert readers.csv_strings(spark, str(tmp_path / "b.csv"), ["name", "text", "more"]).collect()[0] == ("x", None, None)
    (tmp_path / "p.json").write_text('[{}, {"data": {"children": [{"kind": "t1", "data": {"id": "c1", "author": "u", "body": "hi", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "c2", "replies": ""}}, {"kind": "more", "data": {"id": "m", "children": ["z", "y"]}}]}}}}]}}]')
    tree = {r.comment_id: r for r in readers.comment_trees(spark, str(tmp_path / "p.json")).collect()}
    assert tree["c2"].depth == 1 and tree["c2"].parent_comment_id == "c1" and tree["c1"].direct_replies == 1 and tree["m"].is_stub and tree["m"].direct_replies == 2
    decided = spark.createDataFrame([(1, "opinion_main")], "id long, dataset_target string")
    readers.write_buckets(decided, str(tmp_path / "out"))
    for t in funnel.TARGETS:
        assert spark.read.schema("id long").parquet(str(tmp_path / f"out/dataset_target={t}")).count() == (t == "opinion_main")
    readers.write_csv_bom(decided, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(readers.rewrite(spark, str(tmp_path / "t"), lambda d: d.withColumn("y", F.lit(1)))).columns == ["id", "y"]
    with pytest.raises(ValueError):
        readers.rewrite(spark, str(tmp_path / "t"), lambda d: d.filter("id > 0"))
    assert quality.file_inventory(spark, str(tmp_path / "t")).count() > 0


def test_upsert_stream(spark, tmp_path):
    for k, rows in enumerate(([(1, "a", 5, 1), (2, "b", None, 2)], [(1, "c", None, 3), (3, "a", 7, 4)])):
        spark.createDataFrame(rows, "id long, ids string, metric long, ord long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.read_events(spark, str(tmp_path / "in"), "id long, ids string, metric long, ord long")
        incremental.upsert_sink(stream, str(tmp_path / "out"), "id", "ids", ("metric",), "ord", str(tmp_path / "cp")).awaitTermination()
    last = max(tmp_path.glob("out/v=*"), key=lambda p: int(p.name[2:]))
    assert sorted(tuple(r) for r in spark.read.parquet(str(last)).select("id", "ids", "metric").collect()) == [(1, "a;c", 5), (2, "b", None), (3, "a", 7)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 75
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_missing_contract_columns(spark):
    with pytest.raises(ValueError):
        quality.missing_columns(spark.range(1), ["id", "text_raw"])


def test_permutations_as_many_as_in_the_reference(spark):
    rows = [("a", float(k), 2.0 * k) for k in range(30)] + [("b", 1.0, float(k)) for k in range(5)] + [("c", float(k), float(k * k % 7)) for k in range(12)]
    got = {r.asset_id: r for r in finance.permutation_p(spark.createDataFrame(rows, "asset_id string, x double, y double"), "asset_id").collect()}
    assert got["a"].p_value == pytest.approx(1 / 10_000) and got["b"].p_value is None
    assert 0.05 < got["c"].p_value < 1 and got["c"].n_pairs == 12


def test_correlation_of_constant_sides(spark):
    from weirflow.functions.stats import correlation
    from weirflow.operators.finance import spearman

    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", None, 9.0), ("up", 7.0, None), ("up", 3.0, 6.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(correlation("x", "y").alias("r")).collect()}
    assert got.pop("up") == pytest.approx(1.0) and got == {"flat": None, "one": None, "none": None}
    assert {r.k: r.spearman for r in spearman(df.filter("k <> 'none' AND x IS NOT NULL AND y IS NOT NULL"), "k").collect()} == {"flat": None, "one": None, "up": 1.0}
