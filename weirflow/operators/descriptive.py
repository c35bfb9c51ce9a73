"""Descriptive tables at four grouping levels: one GROUPING SETS pass, then the full grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.calendar import OUT, PROJECT, ProjectCalendar
from weirflow.functions.stats import share
from weirflow.operators.trend import platforms
from weirflow.sources.bindings import LABEL_AXES, PLATFORMS

UNTIMED = "untimed"
LEVELS = {3: "overall", 1: "platform", 2: "week_pooled", 0: "platform_week"}
NON_OK = ("low_confidence", "json_parse_failure", "api_failure")
NULLABLE = ("parent_id", "source_container", "query_id", "engagement_score", "author_hash", "automation_risk_score_user")


def risk_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 0.3, "low").when(score < 0.6, "medium").otherwise("high")


def _bucketed(records: DataFrame) -> DataFrame:
    week = F.when(F.col("project_week").isNull() | (F.col("project_week") == OUT), UNTIMED).otherwise(F.col("project_week"))
    return records.withColumn("week", week)


def _levels(df: DataFrame, *aggs: Column) -> DataFrame:
    grouped = df.groupingSets([[], [F.col("platform")], [F.col("week")], [F.col("platform"), F.col("week")]], F.col("platform"), F.col("week"))
    out = grouped.agg(F.grouping_id().alias("gid"), *aggs)
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("gid").cast("int")]
    return out.withColumn("group_level", level).drop("gid")


def level_grid(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Every cell of the four levels, whether or not it has rows."""
    weeks = [*calendar.labels, UNTIMED]
    rows = [("overall", None, None), *(("platform", p, None) for p in PLATFORMS), *(("week_pooled", None, w) for w in weeks), *(("platform_week", p, w) for p in PLATFORMS for w in weeks)]
    return F.broadcast(records.sparkSession.createDataFrame(rows, "group_level string, platform string, week string"))


def _on_grid(records: DataFrame, found: DataFrame, calendar: ProjectCalendar) -> DataFrame:
    g, f = level_grid(records, calendar).alias("g"), found.alias("f")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("group_level", "platform", "week")]
    return g.join(f, same[0] & same[1] & same[2], "left").select("g.*", *[F.col(f"f.`{c}`") for c in found.columns if c not in ("group_level", "platform", "week")])


def summary(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Counts, distinct counts, duplicate rates, medians and quartiles at every level."""
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = _levels(
        _bucketed(records).withColumn("text_length", F.char_length("text_raw")),
        F.count("*").alias("n_total"),
        F.count_if(F.col("annotation_status") == "ok").alias("n_annotation_ok"),
        F.count_if(F.col("dataset_target") == "opinion_untimed").alias("n_opinion_untimed"),
        F.count_distinct("content_id").alias("n_unique_content_id"),
        F.count_distinct("text_raw").alias("n_unique_text_raw"),
        F.count_distinct("parent_id").alias("n_unique_parent_id"),
        F.count_distinct("post_id").alias("n_unique_post_id"),
        F.count_distinct("author_hash").alias("n_unique_author_hash"),
        F.count_distinct("query_id").alias("n_unique_query_id"),
        F.round(F.avg(F.col("is_exact_duplicate").cast("double")), 4).alias("duplicate_rate_exact"),
        F.round(F.avg(F.col("is_near_duplicate").cast("double")), 4).alias("duplicate_rate_near"),
        F.percentile("text_length", quarters).alias("tq"),
        F.percentile("engagement_score", quarters).alias("eq"),
    )
    full = _on_grid(records, found, calendar)
    zero = [c for c in full.columns if c.startswith("n_")]
    n = F.coalesce("n_total", F.lit(0))
    spread = [F.round(F.col(q)[k], 4).alias(f"{name}_{part}") for q, name in (("tq", "text_length"), ("eq", "engagement_score")) for k, part in ((0, "q1"), (1, "median"), (2, "q3"))]
    iqr = [F.round(F.col(q)[2] - F.col(q)[0], 4).alias(f"{name}_iqr") for q, name in (("tq", "text_length"), ("eq", "engagement_score"))]
    non_ok = n - F.coalesce("n_annotation_ok", F.lit(0))
    return full.select("group_level", "platform", "week", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], non_ok.alias("n_annotation_non_ok"), F.round(F.try_divide(100.0 * non_ok, n), 2).alias("pct_annotation_non_ok"), "duplicate_rate_exact", "duplicate_rate_near", *spread, *iqr)


def category_shares(records: DataFrame) -> DataFrame:
    """n and share of every category of seven dimensions at every level; label axes over ok rows only."""
    base = _bucketed(records)
    ok = F.col("annotation_status") == "ok"
    dims = {"language_detected": F.col("language_detected"), "source_container": F.col("source_container"), "automation_risk_bucket": risk_bucket(F.col("automation_risk_score_user"))}
    dims |= {f"label:{axis}": F.col(column) for axis, (column, _) in LABEL_AXES.items()}
    entries = [F.when(ok if d.startswith("label:") else F.lit(True), F.struct(F.lit(d).alias("dimension"), F.coalesce(v, F.lit("(missing)")).alias("category"))) for d, v in dims.items()]
    long = base.select("platform", "week", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("platform", "week", "e.*")
    # The finest counts first; levels are sums of these few rows.
    fine = long.groupBy("platform", "week", "dimension", "category").agg(F.count("*").alias("n"))
    sets = [[F.col("dimension"), F.col("category"), *extra] for extra in ([], [F.col("platform")], [F.col("week")], [F.col("platform"), F.col("week")])]
    rolled = fine.groupingSets(sets, F.col("platform"), F.col("week"), F.col("dimension"), F.col("category")).agg((F.grouping("platform") * 2 + F.grouping("week")).alias("gid"), F.sum("n").alias("n"))
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("gid").cast("int")]
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("gid", "platform", "week", "dimension"))
    return rolled.select(level.alias("group_level"), "platform", "week", "dimension", "category", "n", share(F.col("n"), total).alias("proportion"))


def missing_rates(records: DataFrame, columns=NULLABLE) -> DataFrame:
    """Null count and rate of each nullable column at every level that has rows."""
    wide = _levels(_bucketed(records), F.count("*").alias("n_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot(["group_level", "platform", "week", "n_total"], list(columns), "column", "n_missing")
    return long.select("group_level", "platform", "week", "column", "n_missing", share(F.col("n_missing"), F.col("n_total")).alias("missing_rate"))


def annotation_coverage(records: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """ok rows and the three failure statuses at every level."""
    found = _levels(_bucketed(records), F.count("*").alias("n_total"), F.count_if(F.col("annotation_status") == "ok").alias("n_ok"), *[F.count_if(F.col("annotation_status") == s).alias(f"n_{s}") for s in NON_OK])
    full = _on_grid(records, found, calendar)
    cols = ["n_total", "n_ok", *[f"n_{s}" for s in NON_OK]]
    out = full.select("group_level", "platform", "week", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    failed = sum((F.col(f"n_{s}") for s in NON_OK[1:]), F.col(f"n_{NON_OK[0]}"))
    return out.withColumn("n_non_ok", failed).withColumn("pct_non_ok", F.round(F.try_divide(100.0 * failed, F.col("n_total")), 2))


def category_coverage(registry: DataFrame) -> DataFrame:
    """Distinct assets and core assets of each category."""
    return registry.groupBy("category").agg(F.count_distinct("asset_id").alias("n_assets"), F.count_distinct(F.when(F.col("is_core"), F.col("asset_id"))).alias("n_core"))
