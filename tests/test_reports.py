"""Lookups, totals and lists on small tables, nulls and ties included; the sources beside them."""

import json
import math

import pytest

from weirflow.operators import inference, reports
from weirflow.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_file_and_line_win(spark):
    geo = spark.createDataFrame([("a", "x", 0, 9), ("a", "y", 1, 1), ("a", "z", 1, 2), (None, "n", 1, 3), ("", "e", 1, 4)], "video_id string, country string, file_no int, line_no int")
    posts = spark.createDataFrame([(1, "a", None), (2, "a", "own"), (3, "b", None), (4, None, None)], "id int, post_id string, video_geo string")
    assert rows(reports.with_geo(posts, geo).select("id", "video_geo")) == [(1, "z"), (2, "own"), (3, None), (4, None)]
    assert rows(reports.with_geo(posts.select("id", "post_id"), geo.limit(0)).select("id", "video_geo")) == [(k, None) for k in (1, 2, 3, 4)]


def test_clashing_names_get_the_suffix(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    joined = reports.with_lookup(left, spark.createDataFrame([("a", 7, 8)], "k string, v int, w int"), "k", "_side")
    assert joined.columns == ["k", "v", "v_side", "w"] and rows(joined) == [("a", 1, 7, 8), (None, 2, None, None)]


def test_scores_and_totals(spark):
    users = spark.createDataFrame([("u", 0.8, True), ("w", 0.1, False), ("x", 0.2, None)], "author string, automation_risk_score_user double, is_flagged_bot_suspect boolean")
    comments = spark.createDataFrame([(1, "u", "x"), (2, None, None), (3, "gone", "x")], "id int, author string, platform string")
    assert rows(reports.with_user_scores(comments, users).select("id", "automation_risk_score_user", "is_flagged_bot_suspect")) == [(1, 0.8, True), (2, None, False), (3, None, False)]
    assert rows(reports.cleaning_totals(comments, users)) == [("flagged_pct", "all", 33.3), ("flagged_users", "all", 1.0), ("records", "all", 3.0), ("records", "unknown", 1.0), ("records", "x", 2.0), ("users", "all", 3.0)]
    assert ("flagged_pct", "all", 0.0) in rows(reports.cleaning_totals(comments.limit(0), users.limit(0)))


def test_absent_feature_fails(spark):
    wide = spark.sql("SELECT DATE'2024-01-02' AS observation_date, 1.5D AS f")
    kind = "asset_id string, feature_column string, analysis_tier string, analysis_use string"
    assert [r.project_week for r in reports.selected_features(wide, spark.createDataFrame([("a", "f", "core", "p")], kind)).collect()] == ["W01"]
    with pytest.raises(ValueError):
        reports.selected_features(wide, spark.createDataFrame([("a", "g", "core", "p")], kind))


def test_clean_file_before_raw_ones(spark, tmp_path):
    for name, text in {"b.jsonl": '{"id": 2}\n\nbroken\n', "a.jsonl": '{"id": 1}\n'}.items():
        (tmp_path / name).write_text(text)
    patterns, clean = [str(tmp_path / "*.jsonl"), str(tmp_path / "none*")], tmp_path / "clean" / "c.jsonl"
    read = lambda: [(r.id, r.source_file) for r in readers.preferred_records(spark, str(clean), patterns, "id long").orderBy("id").collect()]
    assert read() == [(1, "a.jsonl"), (2, "b.jsonl")]
    clean.parent.mkdir()
    clean.write_text('{"id": 9}\n')
    assert read() == [(9, "c.jsonl")]
    assert readers.preferred_records(spark, str(tmp_path / "no"), [], "id long").count() == 0


def test_payload_keeps_texts(spark):
    table = spark.createDataFrame([("a: NaN </script", float("nan")), ("NaN", 1.5), (None, float("inf"))], "t string, v double")
    text = readers.html_payload({"one": table})
    assert "</" not in text
    assert json.loads(text) == {"one": [{"t": "a: NaN </script", "v": None}, {"t": "NaN", "v": 1.5}, {"t": None, "v": None}]}


def test_p_values(spark):
    rows = [("a", "x", 1.0)] * 8 + [("a", "y", 2.0)] * 2 + [("b", "x", 2.0)] + [("b", "y", 5.0)] * 5
    df = spark.createDataFrame(rows, "g string, h string, v double")
    table, cells = [[8, 2], [1, 5]], [(i, j) for i in (0, 1) for j in (0, 1)]
    expected = {(i, j): sum(table[i]) * (table[0][j] + table[1][j]) / 16 for i, j in cells}
    x = sum((abs(table[i][j] - expected[i, j]) - 0.5) ** 2 / expected[i, j] for i, j in cells)
    assert inference.chi_square(df, "g", "h").first().p_value == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=1e-6)
    hit = df.selectExpr("g", "h = 'x' AS hit")
    assert inference.fisher(hit, "g", "hit", "a", "b").first().p_value == pytest.approx((math.comb(10, 8) * 6 + 10 * 1 + math.comb(10, 3)) / math.comb(16, 9), abs=1e-6)
    assert 0 < inference.welch(df, "g", "v", "a", "b").first().p_value < 0.05
    assert 0 < inference.mann_whitney(df, "g", "v", "a", "b").first().p_value < 0.05


def test_p_values_without_groups(spark):
    none = spark.createDataFrame([], "g string, h string, v double")
    assert inference.chi_square(none, "g", "h").first().p_value is None
    assert inference.welch(none, "g", "v", "a", "b").first().p_value is None
    assert inference.mann_whitney(none, "g", "v", "a", "b").first().p_value is None
