"""Connected components of an edge table.

Large stars and small stars in turn: every round is a join and an aggregation on
the edges alone, written before the next; the number of rounds is logarithmic in
the size of a component. An edge table of a counted ``ONE_TASK`` rows at most is
one union-find in one task instead, with the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


#: Edges that one task may hold: about 100 bytes each.
ONE_TASK = 500_000


def _union_find(batches):
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (parent := up.get(x, x)) != x:
            up[x] = up.get(parent, parent)
            x = parent
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    found = [(x, r) for x in list(up) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["node", "root"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) but the roots, which are the smallest nodes."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    # Counted with repetitions, which a union-find may have, so few edges are not shuffled; ``edges`` may be read twice.
    if edges.count() <= ONE_TASK:
        return written(edges.coalesce(1).mapInArrow(_union_find, "node long, root long"), "components")
    edges = written(edges.distinct(), "edges")
    sign = None
    while True:
        edges = written(_small(_large(edges)), "stars")
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = new
