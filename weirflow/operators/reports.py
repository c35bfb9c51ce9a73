"""Tables behind reports: lookups on records, cleaning totals, top lists, feature lists and orders of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.functions.text import is_present

TOP_USERS, TOP_COLUMNS, TOP_TESTS = 20, 8, 8


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the last by ``order``; rows without a key are left out."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return rows.filter(is_present(F.col(key).cast("string"))).groupBy(key).agg(last).select(key, "__last.*")


def with_lookup(rows: DataFrame, side: DataFrame, key: str, suffix: str = "") -> DataFrame:
    """All rows with the columns of ``side``, which has a row a key at most; names that both have get ``suffix`` there."""
    taken = set(rows.columns) - {key}
    return rows.join(side.withColumnsRenamed({c: c + suffix for c in side.columns if c in taken}), key, "left")


def with_geo(rows: DataFrame, geo: DataFrame, post: str = "post_id") -> DataFrame:
    """video_geo from (video_id, country, file_no, line_no): the last file wins, then the last line; a value that is there stays."""
    found = last_per_key(geo, "video_id", "file_no", "line_no").select(F.col("video_id").alias(post), F.col("country").alias("__geo"))
    own = F.col("video_geo") if "video_geo" in rows.columns else F.lit(None).cast("string")
    return rows.join(found, post, "left").withColumn("video_geo", F.coalesce(own, "__geo")).drop("__geo")


def with_user_scores(rows: DataFrame, users: DataFrame, author: str = "author") -> DataFrame:
    """Each row with its author's score and flag; without a known author no score and no flag."""
    scores = users.select(author, F.col("automation_risk_score_user"), F.col("is_flagged_bot_suspect").alias("__flag"))
    plain = rows.drop("automation_risk_score_user", "is_flagged_bot_suspect")
    return plain.join(scores, author, "left").withColumn("is_flagged_bot_suspect", F.coalesce("__flag", F.lit(False))).drop("__flag")


def cleaning_totals(rows: DataFrame, users: DataFrame, platform: str = "platform") -> DataFrame:
    """(metric, platform, value): records in all and by platform, users, flagged users and their per cent (0 without users)."""
    records = rows.rollup(platform).agg(F.grouping(platform).alias("__all"), F.count("*").cast("double").alias("value"))
    records = records.select(F.lit("records").alias("metric"), F.when(F.col("__all") == 1, "all").otherwise(F.coalesce(platform, F.lit("unknown"))).alias("platform"), "value")
    flagged = F.count_if("is_flagged_bot_suspect")
    per_cent = F.round(F.coalesce(F.try_divide(100.0 * flagged, F.count("*")), F.lit(0.0)), 1)
    wide = users.agg(F.count("*").cast("double").alias("users"), flagged.cast("double").alias("flagged_users"), per_cent.alias("flagged_pct"))
    long = wide.unpivot([], ["users", "flagged_users", "flagged_pct"], "metric", "value")
    return records.unionByName(long.withColumn("platform", F.lit("all")))


def flagged_users(users: DataFrame, key: str = "author", n: int = TOP_USERS) -> DataFrame:
    """The ``n`` flagged users of the highest score; of equal scores the smaller key first."""
    top = users.filter("is_flagged_bot_suspect").orderBy(F.desc("automation_risk_score_user"), key).limit(n)
    return top.select(key, "automation_risk_score_user", "total_interactions", "exact_duplicate_ratio", "url_interaction_ratio", "hour_coverage_ratio")


def most_missing(rates: DataFrame, n: int = TOP_COLUMNS) -> DataFrame:
    """The ``n`` columns with the highest missing rate over all records."""
    overall = rates.filter(F.col("group_level") == "overall")
    return overall.orderBy(F.desc("missing_rate"), "column").limit(n).select("column", "missing_rate")


def least_p_values(tests: DataFrame, n: int = TOP_TESTS) -> DataFrame:
    """The ``n`` tests of the smallest p-value."""
    return tests.filter(F.col("p_value").isNotNull()).orderBy("p_value", "family", "test_id").limit(n)


def selected_features(features: DataFrame, decisions: DataFrame, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Wide daily features as rows of the chosen (asset_id, feature_column, analysis_tier, analysis_use), inside the calendar.

    Days without a value stay; a chosen column that is absent fails, as a typing error would go unseen otherwise.
    """
    chosen = [r[0] for r in decisions.select("feature_column").distinct().toLocalIterator()]  # one an asset of the registry
    gone = sorted(set(chosen) - set(features.columns))
    if gone:
        raise ValueError(f"feature columns are missing: {gone}")
    inside = features.filter(F.col("observation_date").between(F.lit(calendar.start.date()), F.lit(calendar.end.date())))
    long = inside.select("observation_date", *[F.col(c).cast("double") for c in chosen]).unpivot(["observation_date"], chosen, "feature_column", "daily_log_change")
    # The day's label is that of its first second.
    week = calendar.week(F.col("observation_date").cast("timestamp"))
    joined = long.join(decisions, "feature_column").withColumn("project_week", week)
    return joined.select("observation_date", "project_week", "asset_id", "analysis_tier", "analysis_use", "feature_column", "daily_log_change")


def plan_families(queries: DataFrame, n_weeks: int) -> DataFrame:
    """Query ids by language, and first jobs, of each family of (position, query_id, family, lang); ids in their own order.

    A registry of queries is a list that people write, so a family's ids are one row.
    """
    def ids(lang: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("position", "query_id"))))
        return F.concat_ws(", ", F.transform(found, lambda q: q["query_id"]))

    rows = queries.groupBy("family").agg(ids("en").alias("en_ids"), ids("fa").alias("fa_ids"), F.count("*").alias("n_queries"))
    mark = lambda c: F.when(F.col(c) == "", "—").otherwise("✓")
    shown = lambda c: F.when(F.col(c) == "", "—").otherwise(F.col(c))
    return rows.select("family", mark("en_ids").alias("en"), mark("fa_ids").alias("fa"), shown("en_ids").alias("en_query_ids"), shown("fa_ids").alias("fa_query_ids"), "n_queries", F.lit(n_weeks).cast("long").alias("weeks_per_query"), (F.col("n_queries") * n_weeks).alias("initial_jobs"))


def week_number(label: Column) -> Column:
    """12 of "W12"; null for labels that are no week."""
    return F.when(label.rlike(r"^W\d+$"), F.substring(label, 2, 9).cast("int"))


def place_in(value: Column, order) -> Column:
    """The place of a value in a fixed order, from 1; values that it lacks, and null, come after all."""
    found = F.coalesce(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0))
    return F.when(found > 0, found).otherwise(len(order) + 1)
