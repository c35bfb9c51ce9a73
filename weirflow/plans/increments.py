"""Queries over incremental forms and threads, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weirflow.operators import risk
from weirflow.session import shared_dir
from weirflow.plans.texts import COMMENTS_SQL, comments
from weirflow.sources.bindings import RECORDS_SQL, records, table
from weirflow.streaming import incremental

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _run(stream):
    """A stream over what is there now, as a table in the shared folder: a file sink with a checkpoint, so nothing gathers on the driver."""
    path = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _run_counts(stream):
    """A stream of counts by week and type in full: the memory sink holds one row of each."""
    name = f"s_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(EVENTS).parquet(f"{path.rstrip('/')}*").withColumn("ts", F.col("ts").cast("timestamp"))


def _weekly_stream(spark, sf_dir):
    out = incremental.weekly_counts(_stream(spark, sf_dir), "ts", "1 hour", "event_type")
    return _run_counts(out).select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "event_type", "n")


def _dedup_stream(spark, sf_dir):
    s = _stream(spark, sf_dir).withColumn("content", F.col("event_id") % 3000)
    return _run(incremental.new_contents(s, "content", "ts", "60 days")).groupBy("event_type").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_new"))


def _burst_stream(spark, sf_dir):
    s = _stream(spark, sf_dir).select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("author"), F.expr("timestamp_seconds(1704067200 + (event_id div 4) * 20)").alias("ts"))
    return _run(incremental.bursts(s, "author", "ts", "event_id")).select("event_id", "author", F.col("burst_size").cast("long").alias("burst_size"))


BURST_SQL = """WITH e AS (SELECT event_id, 'u' || (user_id % 40) AS author, 1704067200 + (event_id // 4) * 20 AS t FROM events), w AS (SELECT *, list(t) OVER (PARTITION BY author ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM e)
SELECT event_id, author, len(list_filter(near, lambda x: t - x <= 60)) AS burst_size FROM w"""


def _upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("id"), F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("ids"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("metric"), F.col("event_type").alias("kind"), "event_id")
    key = dict(key="id", ids="ids", metrics=("metric",), order="event_id")
    first = incremental.merge_upsert(e.limit(0), e.filter("event_id < 2000"), **key)
    return incremental.merge_upsert(first, e.filter("event_id >= 2000"), **key).select("id", "ids", "metric", "kind")


UPSERT_SQL = """WITH e AS (SELECT event_id % 700 AS id, 'q' || (event_id % 3) AS q, CASE WHEN event_id % 4 <> 0 THEN event_id END AS metric, event_type AS kind, event_id FROM events)
SELECT id, array_to_string(list_sort(list_distinct(list(q))), ';') AS ids, max(metric) AS metric, arg_min(kind, event_id) AS kind FROM e GROUP BY id"""
MARKS_SQL = f"WITH {RECORDS_SQL} SELECT post_id, max(epoch(date_trunc('second', created_at))::BIGINT) AS watermark_s FROM records WHERE created_at IS NOT NULL GROUP BY 1"


def _marks(spark, sf_dir):
    r = records(spark, sf_dir).filter("created_at IS NOT NULL")
    early = incremental.entity_watermarks(r.filter("content_id % 2 = 0"), None, "post_id", "created_at")
    return incremental.entity_watermarks(r.filter("content_id % 2 = 1"), early, "post_id", "created_at").select("post_id", F.unix_seconds("watermark").alias("watermark_s"))


def _dense(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("t")).agg(F.count("*").alias("n"))
    return incremental.split_dense(counts, 400)


DENSE_SQL = """WITH c AS (SELECT floor(epoch(date_trunc('second', ts)) / 600)::BIGINT AS t, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT min(t) AS a, CASE WHEN max(t) = min(t) THEN 0 ELSE floor(log2(max(t) - min(t)))::BIGINT + 1 END AS k FROM c), lv AS (SELECT a, k, unnest(generate_series(0, k)) AS j FROM e),
s AS (SELECT a, k, j, (t - a) >> j AS cell, sum(n)::BIGINT AS n FROM c CROSS JOIN lv GROUP BY ALL)
SELECT s.a + (s.cell << s.j) AS lo, s.a + ((s.cell + 1) << s.j) AS hi, s.n FROM s LEFT JOIN s AS p ON p.j = s.j + 1 AND p.cell = s.cell >> 1 WHERE (s.j = s.k OR p.n > 400) AND (s.n <= 400 OR s.j = 0)"""

QUERIES = {
    "stream_weekly_counts": (_weekly_stream, "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_new_contents": (_dedup_stream, "SELECT count(DISTINCT event_id % 3000) AS n_new FROM events"),
    "stream_bursts": (_burst_stream, BURST_SQL),
    "upsert_merge": (_upsert, UPSERT_SQL),
    "entity_watermarks": (_marks, MARKS_SQL),
    "dense_intervals": (_dense, DENSE_SQL),
    "thread_responses": (lambda s, d: risk.response_times(comments(s, d)).select("content_id", "parent_author", "response_seconds", "is_self_reply"), f"WITH {COMMENTS_SQL} SELECT c.content_id, p.author AS parent_author, c.t - p.t AS response_seconds, coalesce(c.author = p.author, false) AS is_self_reply FROM comments c LEFT JOIN comments p ON p.content_id = c.parent_comment_id"),
    "first_matches": (lambda s, d: incremental.first_matches(records(s, d), "author_hash", "query_id", order="content_id").select("author_hash", "query_id", "content_id"), f"WITH {RECORDS_SQL} SELECT author_hash, query_id, min(content_id) AS content_id FROM records GROUP BY ALL"),
}
