"""The roles of the data model, derived from the driver's tables.

The derivations are expressions that Spark and DuckDB read alike, so a query and its
SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT

PLATFORMS = ("x", "reddit", "youtube")
# The label sets of the annotations.
SENTIMENTS = ("positive", "negative", "neutral", "mixed", "unclear")
STANCES = ("support", "oppose", "neutral_or_balanced", "unrelated", "unclear")
EMOTIONS = ("anger", "fear", "sadness", "hope", "joy", "disgust", "surprise", "none_or_unclear")
CONTENT_TYPES = ("personal_opinion", "news_or_report", "quotation", "satire", "spam", "unclear")
LANGUAGES = ("fa", "en", "ar", "other")
LABEL_AXES = {"sentiment": ("sentiment_label", SENTIMENTS), "stance": ("stance_label", STANCES), "emotion": ("emotion_label", EMOTIONS), "content_type": ("content_type_label", CONTENT_TYPES)}


def _pick(number: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {number} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: An annotated record from an event.
RECORD = {
    "content_id": "cast(event_id as string)",
    "platform": _pick("user_id % 3", PLATFORMS),
    "parent_id": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('p', cast(event_id % 400 as string)) END",
    "post_id": "concat('t', cast((event_id - event_id % 10) / 10 as string))",
    "post_no": "event_id % 1000",
    "dataset_target": "CASE WHEN event_id % 37 = 0 THEN 'opinion_untimed' WHEN event_id % 3 = 0 THEN 'opinion_limited' ELSE 'opinion_main' END",
    "text_raw": "props",
    "source_container": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('s', cast(user_id % 11 as string)) END",
    "query_id": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('Q', cast(event_id % 7 as string)) END",
    "query_version": "concat('v', cast(event_id % 2 as string))",
    "language_detected": _pick("user_id % 4", LANGUAGES),
    "engagement_score": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END",
    "author_hash": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('u', cast(user_id as string)) END",
    "automation_risk_score_user": "CASE WHEN user_id % 12 > 9 THEN NULL ELSE (user_id % 12) / 10.0e0 END",
    "is_flagged_bot_suspect": "user_id % 12 IN (7, 8, 9)",
    "is_exact_duplicate": "event_id % 50 = 1",
    "is_near_duplicate": "event_id % 16 = 0",
    "target": "concat('T', cast(event_id % 3 as string))",
    "sentiment_label": "CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'mixed' ELSE 'unclear' END",
    "stance_label": _pick("(event_id + user_id) % 5", STANCES),
    "emotion_label": _pick("(event_id + 3 * user_id) % 8", EMOTIONS),
    "content_type_label": _pick("(event_id + user_id) % 6", CONTENT_TYPES),
    "confidence": "(event_id % 100) / 100.0e0",
    "annotation_status": "CASE WHEN event_id % 40 = 10 THEN 'low_confidence' WHEN event_id % 40 = 20 THEN 'json_parse_failure' WHEN event_id % 40 = 30 THEN 'api_failure' WHEN event_id % 40 = 0 THEN 'pending_annotation' ELSE 'ok' END",
}

RECORDS_SQL = "records AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RECORD.items() if c != "post_id") + f", concat('t', cast((event_id - event_id % 10) // 10 as string)) AS post_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE ts END AS created_at, {PROJECT.week_sql('CASE WHEN event_id % 37 = 0 THEN NULL ELSE ts END')} AS project_week FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated records; every 37th has no time."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    created = F.expr("CASE WHEN event_id % 37 = 0 THEN NULL ELSE ts END")
    exprs = {c: F.expr(e) for c, e in RECORD.items()} | {"post_id": F.expr("concat('t', cast((event_id - event_id % 10) div 10 as string))")}
    return events.select(*[e.alias(c) for c, e in exprs.items()], created.alias("created_at"), PROJECT.week(created).alias("project_week"))


#: A text record from a document.
TEXT = {"record_id": "doc_id", "platform": _pick("doc_id % 3", PLATFORMS), "text": "text", "lang": "lang", "source": "source", "week_no": "doc_id % 4"}
TEXTS_SQL = "texts AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TEXT.items()) + " FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*[F.expr(e).alias(c) for c, e in TEXT.items()])


#: Daily series over all orders: the average order price of each priority is an asset.
ASSETS_SQL = "assets AS (SELECT cast(o_orderdate as date) AS observation_date, o_orderpriority AS asset_id, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("observation_date"), F.col("o_orderpriority").alias("asset_id")).agg(F.avg("o_totalprice").alias("value"))
