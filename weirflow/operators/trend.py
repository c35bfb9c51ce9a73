"""Weekly class trends and outcome shares over the gap-free grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.functions.stats import share, wilson_high, wilson_low
from weirflow.sources.bindings import PLATFORMS

LOW_SAMPLE = 30


def flags(n: Column) -> list[Column]:
    """is_data_gap, is_low_sample; is_partial_week comes with the calendar."""
    return [(n == 0).alias("is_data_gap"), ((n > 0) & (n < LOW_SAMPLE)).alias("is_low_sample")]


def platforms(df: DataFrame, names=PLATFORMS) -> DataFrame:
    return df.sparkSession.createDataFrame([(p,) for p in names], "platform string")


def grid(df: DataFrame, calendar: ProjectCalendar = PROJECT, names=PLATFORMS) -> DataFrame:
    """Every platform in every week: fixed dimensions, a few dozen rows."""
    weeks = calendar.weeks(df.sparkSession).select("project_week", "is_partial_week")
    return F.broadcast(platforms(df, names).crossJoin(weeks))


def dimension(df: DataFrame, column: str, values) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string"))


def class_trend(records: DataFrame, column: str, classes, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """n, count, proportion and Wilson interval of each class by platform and week, zero counts and gaps included."""
    ok = records.filter(F.col("annotation_status") == "ok")
    # One pass: counts by class, from which the cells' totals follow without another scan.
    counts = ok.groupBy("platform", "project_week", F.col(column).alias("class_label")).agg(F.count("*").alias("class_count"))
    totals = counts.groupBy("platform", "project_week").agg(F.sum("class_count").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("class_label", F.lit("")), "class_count"))).alias("of"))
    cells = grid(records, calendar).join(totals, ["platform", "project_week"], "left").crossJoin(dimension(records, "class_label", classes))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce(F.try_element_at("of", F.col("class_label")), F.lit(0))
    out = cells.select("platform", "project_week", "class_label", n.alias("n"), k.alias("class_count"), "is_partial_week")
    n, k = F.col("n"), F.col("class_count")
    return out.select("platform", "project_week", "class_label", "n", "class_count", share(k, n).alias("class_proportion"), F.round(wilson_low(k, n), 4).alias("wilson_ci_low"), F.round(wilson_high(k, n), 4).alias("wilson_ci_high"), "is_partial_week", *flags(n))


#: outcome -> (column, value that counts)
OUTCOMES = {
    "support_share": ("stance_label", "support"),
    "oppose_share": ("stance_label", "oppose"),
    "unclear_share": ("stance_label", "unclear"),
    "negative_sentiment_share": ("sentiment_label", "negative"),
    "anger_share": ("emotion_label", "anger"),
    "automation_risk_share": ("is_flagged_bot_suspect", True),
}


def weekly_outcomes(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Six outcome shares by platform and week: one conditional count each, unpivoted on the grid."""
    ok = records.filter(F.col("annotation_status") == "ok")
    hits = [F.count_if(F.col(c) == F.lit(v)).alias(o) for o, (c, v) in OUTCOMES.items()]
    wide = grid(records, calendar).join(ok.groupBy("platform", "project_week").agg(F.count("*").alias("n"), *hits), ["platform", "project_week"], "left")
    long = wide.unpivot(["platform", "project_week", "n"], list(OUTCOMES), "outcome_id", "k").select("platform", "project_week", "outcome_id", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("k", F.lit(0)).alias("k"))
    n, k = F.col("n_records"), F.col("k")
    return long.select("platform", "project_week", "outcome_id", share(k, n).alias("outcome_value"), "n_records", F.round(wilson_low(k, n), 4).alias("ci_low"), F.round(wilson_high(k, n), 4).alias("ci_high"))
