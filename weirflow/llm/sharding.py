"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of the key. A
bucket splits on one more bit only while it is over the byte limit, so shards
have different depths. Bytes are summed once for each prefix of ``depth`` bits
and the sums are rolled up to every shorter prefix; a shard is the shortest
prefix whose documents fit. Buckets that are still too large at that depth go
on with eight bits more, on their own documents alone.

Defined results: null keys are hashed by their text; null and empty texts have
0 bytes; a single document over the limit, and rows of equal key whose hash can
not tell them apart, stay one shard that says ``fits = false``; repeated rows
share a shard; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BITS = 60
LIMIT = 32 << 20
#: Up to so many shards the directory is broadcast: about 40 bytes each.
BROADCAST_SHARDS = 100_000


def key_hash(key: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the key, which SQL elsewhere can compute as well."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth) -> Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})") if isinstance(h, str) else F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shards of rows (h, bytes): depth, prefix, shard_bytes, shard_rows."""
    total = rows.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.sparkSession.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long")
    depth, least, todo, parts = min(BITS, max(2, math.ceil(math.log2(max(1, (total.b or 0) / limit))) + 6)), 0, rows, []
    while True:
        cells = todo.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        sums = (
            cells.select(F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("depth"), "cell", "bytes", "rows")
            .groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        )
        sums = written(sums, "shard-sums")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        over = sums.filter(~fits)
        # A prefix is reached if the one that is a bit shorter was too large; the shortest prefixes always are.
        split = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        reached = sums.filter(F.col("depth") > least).join(split, ["depth", "prefix"], "left_semi").unionByName(sums.filter(F.col("depth") == least))
        parts.append(reached.filter(fits if depth < BITS else fits | (F.col("depth") == BITS)))
        left = over.filter(F.col("depth") == depth)
        if depth == BITS or not left.count():
            break
        todo = written(todo.join(left.select(F.col("prefix").alias("cell")), F.shiftright("h", BITS - depth) == F.col("cell"), "left_semi").select("h", "bytes"), "shard-left")
        # What is left is too large at ``depth``: its prefixes of one bit more are reached.
        least, depth = depth, min(BITS, depth + 8)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("depth").cast("int").alias("depth"), "prefix", "shard_bytes", "shard_rows")


def shard(docs: DataFrame, key="doc_id", text="text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard (its prefix as bits), shard_depth, shard_bytes, shard_fits and n_bytes.

    Columns of ``docs`` by these names are replaced.
    """
    own = ("n_bytes", "shard", "shard_depth", "shard_bytes", "shard_fits")
    h, size = key_hash(F.col(key), F.col(text)), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rows = written(docs.select(h.alias("h"), size.alias("bytes")), "shard-rows")
    shards = written(directory(rows, limit), "shard-directory")
    about = shards.agg(F.min("depth").alias("least"), F.count("*").alias("n")).first()
    least = about.least or 0
    # One entry for each prefix of the shortest depth, with the shards below it.
    index = shards.groupBy(F.expr(f"shiftright(prefix, depth - {least})").alias("__entry")).agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes")).alias("__shards"))
    hashed = docs.drop(*own).withColumns({"__h": h, "n_bytes": size}).withColumn("__entry", F.shiftright("__h", BITS - least))
    found = hashed.join(F.broadcast(index) if about.n <= BROADCAST_SHARDS else index, "__entry")
    mine = F.filter("__shards", lambda s: F.call_function("shiftright", F.col("__h"), (F.lit(BITS) - s["depth"]).cast("int")) == s["prefix"])[0]
    bits = F.when(F.col("__s.depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("__s.prefix"), F.col("__s.depth"), F.lit("0")))
    return found.withColumn("__s", mine).select(*[c for c in docs.columns if c not in own], "n_bytes", bits.alias("shard"), F.col("__s.depth").alias("shard_depth"), F.col("__s.shard_bytes").alias("shard_bytes"), (F.col("__s.shard_bytes") <= limit).alias("shard_fits"))
