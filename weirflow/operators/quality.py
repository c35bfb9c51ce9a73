"""Data-quality audits: profiles, grades, manifests, reconciliation and check tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.dates import iso_week
from weirflow.functions.text import is_empty_text, is_present


def profile(records: DataFrame, key: str, ts: str, text: str, *by: str) -> DataFrame:
    """Counts, distinct and duplicate ids, missing parts, first and last time, days and ISO weeks: one pass."""
    n, distinct = F.count("*"), F.count_distinct(key)
    return records.groupBy(*by).agg(n.alias("raw_n"), distinct.alias("distinct_ids"), (F.count(key) - distinct).alias("duplicate_ids"), F.count_if(F.col(key).isNull()).alias("missing_id_n"), F.count_if(is_empty_text(F.col(text))).alias("missing_text_n"), F.count_if(F.col(ts).isNull()).alias("missing_timestamp_n"), F.count_distinct(F.to_date(ts)).alias("n_days"), F.count_distinct(iso_week(F.col(ts))).alias("n_iso_weeks"))


def grade(profiles: DataFrame) -> DataFrame:
    """A to D by missing shares, with the reasons."""
    pct = lambda c: F.try_divide(100.0 * F.col(c), F.col("raw_n"))
    ids, text, ts, dup = pct("missing_id_n"), pct("missing_text_n"), pct("missing_timestamp_n"), pct("duplicate_ids")
    g = F.when(F.coalesce("raw_n", F.lit(0)) == 0, "D").when(ids > 20, "D").when((text > 20) | (ts > 20), "C").when((text > 0) | (ts > 0) | (dup > 0), "B").otherwise("A")
    reasons = F.concat_ws(";", F.when(F.coalesce("raw_n", F.lit(0)) == 0, "empty"), F.when(ids > 20, "missing_id"), F.when(text > 0, "missing_text"), F.when(ts > 0, "missing_timestamp"), F.when(dup > 0, "duplicate_id"))
    return profiles.withColumn("grade", g).withColumn("reasons", reasons)


def run_manifest(rows: DataFrame, *by: str) -> DataFrame:
    """Counters of each run bucket, with first and last time in seconds."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("author_hash").alias("n_authors"), F.min(F.unix_seconds("created_at")).alias("first_s"), F.max(F.unix_seconds("created_at")).alias("last_s"))


def query_week_audit(rows: DataFrame, weeks: DataFrame, queries: list[str]) -> DataFrame:
    """Distinct contents and authors of every query in every week, the empty ones too."""
    grid = F.broadcast(rows.sparkSession.createDataFrame([(q,) for q in queries], "query_id string").crossJoin(weeks.select("project_week")))
    counts = rows.groupBy("query_id", "project_week").agg(F.count_distinct("content_id").alias("n_contents"), F.count_distinct("author_hash").alias("n_authors"))
    out = grid.join(counts, ["query_id", "project_week"], "left").select("query_id", "project_week", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_contents", "n_authors")])
    return out.withColumn("status", F.when(F.col("n_contents") == 0, "EMPTY").otherwise("OK"))


def weekly_volume(rows: DataFrame, weeks: DataFrame) -> DataFrame:
    """Rows, posts and users by week; LOW is under a quarter of the median of weeks that have any."""
    counts = F.broadcast(weeks.select("project_week")).join(rows.groupBy("project_week").agg(F.count("*").alias("n_rows"), F.count_distinct("post_id").alias("n_posts"), F.count_distinct("author_hash").alias("n_users")), "project_week", "left").select("project_week", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_posts", "n_users")])
    median = F.broadcast(counts.filter("n_rows > 0").agg(F.percentile("n_rows", F.lit(0.5)).alias("m")))
    status = F.when(F.col("n_rows") == 0, "EMPTY").when(F.col("n_rows") < 0.25 * F.col("m"), "LOW").otherwise("OK")
    return counts.crossJoin(median).select("project_week", "n_rows", "n_posts", "n_users", status.alias("status"))


def check_table(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each assertion: how many rows break it and whether it passed; one pass."""
    wide = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    return wide.unpivot([], list(checks), "check_name", "n_failed").withColumn("passed", F.col("n_failed") == 0)


def count_by_status(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count("*").alias("n_jobs"))


def file_inventory(spark, path: str) -> DataFrame:
    """SHA-256 and size of every file of a folder, read through Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def missing_columns(df: DataFrame, required) -> None:
    """Fails, naming them, if contract columns are missing."""
    gone = sorted(set(required) - set(df.columns))
    if gone:
        raise ValueError(f"contract columns are missing: {gone}")


def synthetic_warning(name: str, df: DataFrame) -> str | None:
    """A warning if a file's name or an is_synthetic column says that its rows are made up."""
    if "is_synthetic" in df.columns and df.filter(F.col("is_synthetic")).limit(1).count():
        return f"{name}: rows are marked is_synthetic"
    return f"{name}: the name says synthetic" if any(w in name.lower() for w in ("sample", "synthetic")) else None


def kept_and_excluded(df: DataFrame, key: Column, value: str) -> DataFrame:
    """The analytical cleaning contract: each row with the reason it is excluded for, or none."""
    return df.withColumn("exclusion_reason", F.when(~is_present(key.cast("string")), "missing_key").when(F.col(value).isNull(), "missing_value").when(F.isnan(F.col(value).cast("double")), "not_a_number").when(F.col(value) <= 0, "not_positive"))
