"""The registered query of each operator, with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontam, exact_dedup, minhash, mixing, sharding, suffix, toxicity, warc, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_fits")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(warc.round_trip(_table(spark, sf_dir, "pages")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", (F.col("n_removed") > 0).alias("repeats"))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT depth, h >> ({sharding.BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM d, range(0, {sharding.BITS} + 1) t(depth) WHERE depth <= 24 OR depth = {sharding.BITS} GROUP BY ALL),
fit AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(s.depth) AS shard_depth
  FROM d JOIN sums s ON s.prefix = d.h >> ({sharding.BITS} - s.depth)
  WHERE s.shard_bytes <= {sharding.LIMIT} OR s.n = 1 OR s.depth = {sharding.BITS} GROUP BY ALL)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(s.prefix), shard_depth::INT, '0') END AS shard,
       shard_depth::INT AS shard_depth, s.shard_bytes, s.shard_bytes <= {sharding.LIMIT} AS shard_fits
FROM fit f JOIN sums s ON s.depth = f.shard_depth AND s.prefix = f.h >> ({sharding.BITS} - f.shard_depth)
"""

OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


#: 8 groups of 5 hexadecimal digits are 4 base-32 letters each.
OP6_SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM p),
g AS (SELECT hex, max(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN g USING (hex)
"""

OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT links.v, r.c FROM r JOIN links ON links.u = r.v),
c AS (SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


#: Every 50-byte string of every text, as hexadecimal digits, and the smallest id that has it.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
k AS (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS k FROM d),
w AS (SELECT r, doc_id, k, md5(substr(h, 2 * k + 1, 100)) AS s FROM k),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT r, k, count(*) FILTER (WHERE before IS NULL OR k > before + 50) OVER (PARTITION BY r ORDER BY k) AS g FROM hit),
spans AS (SELECT r, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY r, g),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT d.r, doc_id, n, h, coalesce(string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a), '') AS head, coalesce(max(b), 0) AS tail,
  coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans FROM d LEFT JOIN cuts ON cuts.r = d.r GROUP BY ALL)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(head || substr(h, 2 * tail + 1))) AS kept_sha256 FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_suffix_dedup": OP10_SQL, "op5_minhash": OP5_SQL, "op6_warc": OP6_SQL, "op2_extendible_shards": OP2_SQL, "op4_exact_dedup": OP4_SQL}
