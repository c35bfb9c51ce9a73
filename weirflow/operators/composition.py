"""Composition of the weekly records: who and what a week's numbers come from.

Every table is on the platform x week grid; concentrations count per key first and take the
top of those counts, so a hot author or parent is one row by then. Ties go
to the larger count, then the smaller name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.functions.stats import share, wilson_high, wilson_low
from weirflow.operators.descriptive import risk_bucket
from weirflow.operators.trend import dimension, flags, grid
from weirflow.sources.bindings import LANGUAGES, PLATFORMS

CELL = ["platform", "project_week"]
TOP_SOURCES = 5


def _ok(records: DataFrame) -> DataFrame:
    return records.filter(F.col("annotation_status") == "ok")


def _zero(*names: str):
    return [F.coalesce(c, F.lit(0)).alias(c) for c in names]


def platform_share(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    counts = _ok(records).groupBy(*CELL).agg(F.count("*").alias("n_platform"))
    out = grid(records, calendar).join(counts, CELL, "left").select(*CELL, "is_partial_week", *_zero("n_platform"))
    out = out.withColumn("n_total_week", F.sum("n_platform").over(Window.partitionBy("project_week")))
    return out.select(*CELL, "n_platform", "n_total_week", share(F.col("n_platform"), F.col("n_total_week")).alias("platform_share"), "is_partial_week", *flags(F.col("n_total_week")))


def source_share(records: DataFrame, calendar: ProjectCalendar = PROJECT, top: int = TOP_SOURCES) -> DataFrame:
    """The ``top`` sources of each cell and a row for the others."""
    counts = records.groupBy(*CELL, F.coalesce("source_container", F.lit("(unknown)")).alias("source_container")).agg(F.count("*").alias("n_source"))
    best = Window.partitionBy(*CELL).orderBy(F.desc("n_source"), "source_container")
    ranked = counts.withColumns({"rank": F.row_number().over(best).cast("long"), "n_week": F.sum("n_source").over(Window.partitionBy(*CELL))})
    tops = ranked.filter(F.col("rank") <= top)
    cells = grid(records, calendar)
    named = tops.join(cells, CELL).select(*CELL, "source_container", "rank", "n_source", "n_week", "is_partial_week")
    rest = cells.join(tops.groupBy(*CELL).agg(F.max("n_week").alias("n_week"), F.sum("n_source").alias("n_top")), CELL, "left")
    n = F.coalesce("n_week", F.lit(0))
    others = rest.select(*CELL, F.lit("(others)").alias("source_container"), F.lit(top + 1).cast("long").alias("rank"), (n - F.coalesce("n_top", F.lit(0))).alias("n_source"), n.alias("n_week"), "is_partial_week")
    return named.unionByName(others).select(*CELL, "source_container", "rank", "n_source", "n_week", share(F.col("n_source"), F.col("n_week")).alias("source_share"), "is_partial_week", *flags(F.col("n_week")))


def language_share(records: DataFrame, calendar: ProjectCalendar = PROJECT, languages=LANGUAGES) -> DataFrame:
    counts = records.groupBy(*CELL, F.col("language_detected").alias("language")).agg(F.count("*").alias("n_lang"))
    totals = counts.groupBy(*CELL).agg(F.sum("n_lang").alias("n_week"))
    out = grid(records, calendar).crossJoin(dimension(records, "language", languages)).join(counts, [*CELL, "language"], "left").join(totals, CELL, "left")
    out = out.select(*CELL, "language", "is_partial_week", *_zero("n_lang", "n_week"))
    return out.select(*CELL, "language", "n_lang", "n_week", share(F.col("n_lang"), F.col("n_week")).alias("lang_share"), "is_partial_week", *flags(F.col("n_week")))


def content_type_share(records: DataFrame, calendar: ProjectCalendar = PROJECT, tracked=("news_or_report", "personal_opinion")) -> DataFrame:
    """The tracked content types and the rest, over ok rows."""
    hits = [F.count_if(F.col("content_type_label") == t).alias(t) for t in tracked]
    wide = grid(records, calendar).join(_ok(records).groupBy(*CELL).agg(F.count("*").alias("n_ok_week"), *hits), CELL, "left").select(*CELL, "is_partial_week", *_zero("n_ok_week", *tracked))
    wide = wide.withColumn("(other_types)", F.col("n_ok_week") - sum((F.col(t) for t in tracked[1:]), F.col(tracked[0])))
    long = wide.unpivot([*CELL, "is_partial_week", "n_ok_week"], [*tracked, "`(other_types)`"], "content_type", "n_type")
    return long.select(*CELL, "content_type", "n_type", "n_ok_week", share(F.col("n_type"), F.col("n_ok_week")).alias("type_share"), "is_partial_week", *flags(F.col("n_ok_week")))


def query_share(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Each query and version of a cell; an empty cell has one row without them."""
    unknown = F.lit("(unknown)")
    counts = records.groupBy(*CELL, F.coalesce("query_id", unknown).alias("query_id"), F.coalesce("query_version", unknown).alias("query_version")).agg(F.count("*").alias("n_query"))
    counts = counts.withColumn("n_week", F.sum("n_query").over(Window.partitionBy(*CELL)))
    out = grid(records, calendar).join(counts, CELL, "left").select(*CELL, "query_id", "query_version", "is_partial_week", *_zero("n_query", "n_week"))
    return out.select(*CELL, "query_id", "query_version", "n_query", "n_week", share(F.col("n_query"), F.col("n_week")).alias("query_share"), "is_partial_week", *flags(F.col("n_week")))


def duplicate_share(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    counts = records.groupBy(*CELL).agg(F.count("*").alias("n_total"), F.count_if("is_exact_duplicate").alias("n_exact_duplicate"), F.count_if("is_near_duplicate").alias("n_near_duplicate"))
    out = grid(records, calendar).join(counts, CELL, "left").select(*CELL, "is_partial_week", *_zero("n_total", "n_exact_duplicate", "n_near_duplicate"))
    n = F.col("n_total")
    return out.select(*CELL, "n_total", "n_exact_duplicate", "n_near_duplicate", share(F.col("n_exact_duplicate"), n).alias("exact_duplicate_share"), share(F.col("n_near_duplicate"), n).alias("near_duplicate_share"), "is_partial_week", *flags(n))


def author_concentration(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Distinct and missing authors and the most frequent author's share of all rows."""
    per = records.groupBy(*CELL, "author_hash").agg(F.count("*").alias("n"))
    known = F.col("author_hash").isNotNull()
    counts = per.groupBy(*CELL).agg(F.sum("n").alias("n_total"), F.count_if(known).alias("n_unique_authors"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_missing_author_hash"), F.max(F.when(known, F.col("n"))).alias("top_author_n"))
    out = grid(records, calendar).join(counts, CELL, "left").select(*CELL, "is_partial_week", *_zero("n_total", "n_unique_authors", "n_missing_author_hash", "top_author_n"))
    top = F.when(F.col("top_author_n") > 0, share(F.col("top_author_n"), F.col("n_total")))
    return out.select(*CELL, "n_total", "n_unique_authors", "n_missing_author_hash", "top_author_n", top.alias("top_author_share"), "is_partial_week", *flags(F.col("n_total")))


def risk_share(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    bucket = risk_bucket(F.col("automation_risk_score_user"))
    names = ("high", "medium", "low", "unknown")
    counts = records.groupBy(*CELL).agg(F.count("*").alias("n_total"), F.count_if("is_flagged_bot_suspect").alias("n_flagged_bot"), *[F.count_if(bucket == b).alias(f"n_risk_{b}") for b in names])
    cols = ["n_total", "n_flagged_bot", *[f"n_risk_{b}" for b in names]]
    out = grid(records, calendar).join(counts, CELL, "left").select(*CELL, "is_partial_week", *_zero(*cols))
    n = F.col("n_total")
    return out.select(*CELL, *cols, share(F.col("n_flagged_bot"), n).alias("bot_suspect_share"), share(F.col("n_risk_high"), n).alias("risk_high_share"), "is_partial_week", *flags(n))


def _top(records: DataFrame, column: str, name: str) -> DataFrame:
    per = records.filter(F.col(column).isNotNull()).groupBy(*CELL, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(column).alias("key")))
    return per.groupBy(*CELL).agg(best.alias("t")).select(*CELL, F.col("t.key").alias(name), (-F.col("t.less")).alias(f"{name}_n"))


def parent_concentration(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """The largest parent and the largest container of each cell."""
    out = grid(records, calendar).join(records.groupBy(*CELL).agg(F.count("*").alias("n_total")), CELL, "left").join(_top(records, "parent_id", "top_parent"), CELL, "left").join(_top(records, "source_container", "top_container"), CELL, "left")
    out = out.select(*CELL, "is_partial_week", F.col("top_parent").alias("top_parent_id"), "top_container", *_zero("n_total", "top_parent_n", "top_container_n"))
    n = F.col("n_total")
    return out.select(*CELL, "n_total", "top_parent_id", "top_parent_n", F.when(F.col("top_parent_n") > 0, share(F.col("top_parent_n"), n)).alias("top_parent_share"), "top_container", "top_container_n", F.when(F.col("top_container_n") > 0, share(F.col("top_container_n"), n)).alias("top_container_share"), "is_partial_week", *flags(n))


def sentiment_adjusted(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """The raw positive rate beside the mean of the authors' own rates (one author, one vote)."""
    positive = (F.col("sentiment_label") == "positive").cast("int")
    per = _ok(records).groupBy(*CELL, "author_hash").agg(F.count("*").alias("n"), F.sum(positive).alias("k"))
    known = F.col("author_hash").isNotNull()
    cell = per.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("k").alias("n_positive_raw"), F.count_if(known).alias("n_authors_in_balanced"), F.round(F.avg(F.when(known, F.col("k") / F.col("n"))), 4).alias("balanced_positive_rate"))
    out = grid(records, calendar).join(cell, CELL, "left").select(*CELL, "is_partial_week", "balanced_positive_rate", *_zero("n", "n_positive_raw", "n_authors_in_balanced"))
    n, k, a, rate = (F.col(c) for c in ("n", "n_positive_raw", "n_authors_in_balanced", "balanced_positive_rate"))
    # The rate is rounded first, then the count, half to even.
    votes = F.bround(rate * a).cast("long")
    raw = share(k, n)
    return out.select(*CELL, "n", "n_authors_in_balanced", "n_positive_raw", raw.alias("raw_positive_rate"), F.round(wilson_low(k, n), 4).alias("raw_ci_low"), F.round(wilson_high(k, n), 4).alias("raw_ci_high"), "balanced_positive_rate", F.round(wilson_low(votes, a), 4).alias("balanced_ci_low"), F.round(wilson_high(votes, a), 4).alias("balanced_ci_high"), F.round(rate - raw, 4).alias("rate_delta"), "is_partial_week", *flags(n))


PLATFORM_NAMES = PLATFORMS
