"""Deterministic sampling, quotas and shards: ranks of a seeded hash, never a random order.

The hash is MD5 of seed and id, which other engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.ids import shard

SEED = 1405


def order_key(c: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def stratified_cap(df: DataFrame, key: str, cell: tuple[str, ...], cap: int, seed: int = SEED, whole: Column | None = None) -> DataFrame:
    """At most ``cap`` rows of each cell; rows for which ``whole`` holds are all kept."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(order_key(F.col(key), seed), key))
    keep = F.col("__r") <= cap
    keep = keep if whole is None else keep | F.coalesce(whole, F.lit(False))
    return df.withColumn("__r", rank).filter(keep).drop("__r")


def quota_sample(df: DataFrame, key: str, cell: tuple[str, ...], quota: int, total: int, seed: int = SEED) -> DataFrame:
    """``quota`` rows of each cell, then what short cells leave goes to the others in hash order, up to ``total``."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(order_key(F.col(key), seed), key))
    ranked = df.withColumn("__r", rank)
    first = ranked.filter(F.col("__r") <= quota).drop("__r").withColumn("sample_pass", F.lit(1))
    cells = ranked.filter(F.col("__r") <= quota).count()  # quota x cells at most
    left = max(0, total - cells)
    # A limit over an order is a bounded heap in every task.
    second = ranked.filter(F.col("__r") > quota).orderBy(order_key(F.col(key), seed), key).limit(left).drop("__r").withColumn("sample_pass", F.lit(2))
    return first.unionByName(second)


def agreement_subset(sample: DataFrame, key: str, least: int = 120, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """max(least, share of the sample) rows, for a second annotator."""
    n = max(least, round(share * sample.count()))
    return sample.orderBy(order_key(F.col(key), seed + 1), key).limit(n)


def blinded_audit(df: DataFrame, key: str, cell: tuple[str, ...], n: int, seed: int = SEED) -> DataFrame:
    """n rows of each cell in a shuffled order under neutral ids; the cell is the answer key."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(order_key(F.col(key), seed), key))
    picked = df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
    number = F.row_number().over(Window.orderBy(order_key(F.col(key), seed + 7), key))
    return picked.withColumn("audit_id", F.format_string(f"RA{seed}-%04d", number))


def replace_invalid(sample: DataFrame, invalid: DataFrame, pool: DataFrame, key: str, cell: tuple[str, ...], seed: int = SEED) -> DataFrame:
    """``sample`` with each invalid row replaced by the next candidate of its cell in hash order; rows without one are left out."""
    bad = sample.join(invalid.select(key).distinct(), key, "left_semi")
    good = sample.join(invalid.select(key).distinct(), key, "left_anti")
    place = Window.partitionBy(*cell).orderBy(order_key(F.col(key), seed), key)
    wanted = bad.select(*cell, F.row_number().over(place).alias("__r"))
    fresh = pool.join(sample.select(key), key, "left_anti").join(invalid.select(key).distinct(), key, "left_anti").withColumn("__r", F.row_number().over(place))
    return good.unionByName(fresh.join(wanted, [*cell, "__r"]).select(*sample.columns))


def repair_ids(rows: DataFrame, fixes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``fixes`` (key, column, version) has one; the latest version wins."""
    last = fixes.groupBy(key).agg(F.max_by(column, "version").alias("__new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def sharded(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("shard", shard(F.col(key).cast("string"), n))
