"""Duplicate groups among short texts: equal texts, and near-duplicate clusters inside cells.

Near-duplicates follow the classical recipe: k-word shingles, MinHash, banding,
exact verification, connected components. Cells (a platform's week) bound what
can meet, so a cell's key is part of every bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.calendar import OUT
from weirflow.functions.text import normalized, shingles
from weirflow.session import shared_dir

LEAST_LENGTH = 10
PERMS, BANDS = 64, 32
THRESHOLD = 0.8


def text_groups(records: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """duplicate_text_diff_id and duplicate_text_group_id: equal lower-cased, trimmed texts of ten characters or more."""
    long = F.char_length(F.coalesce(text, F.lit(""))) >= LEAST_LENGTH
    hashed = records.withColumn("__h", F.when(long, F.substring(F.sha1(normalized(F.col(text)).cast("binary")), 1, 16)))
    # Counted apart and joined back: a hot text is one row of the counts.
    groups = hashed.filter(F.col("__h").isNotNull()).groupBy("__h").agg(F.count("*").alias("__n")).filter("__n > 1")
    joined = hashed.join(groups, "__h", "left")
    return joined.select(*[F.col(c) for c in records.columns], F.col("__n").isNotNull().alias("duplicate_text_diff_id"), F.when(F.col("__n").isNotNull(), F.concat(F.lit("txt_"), "__h")).alias("duplicate_text_group_id"))


def near_pairs(records: DataFrame, key: str, text: str, cell: list[str], k: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): texts of a cell whose shingle sets have at least ``threshold`` in common.

    Equal shingle sets are one node first, so copies do not multiply pairs.
    """
    timed = [F.col(c).isNotNull() & (F.col(c).cast("string") != OUT) for c in cell]
    checked = records.filter(F.char_length(F.coalesce(text, F.lit(""))) >= LEAST_LENGTH).filter(reduce(lambda a, b: a & b, timed))
    sets = checked.select(F.col(key).alias("id"), F.struct(*cell).alias("cell"), F.array_sort(shingles(F.col(text), k)).alias("s")).filter(F.size("s") > 0)
    nodes = sets.groupBy("cell", F.xxhash64("s").alias("node")).agg(F.min("id").alias("id"), F.min("s").alias("s"))
    # Shingles are hashed once; the permutations are aggregates over the exploded hashes, in generated code.
    hashes = nodes.select("cell", "id", F.explode("s").alias("x")).select("cell", "id", F.xxhash64("x").alias("x"))
    least = hashes.groupBy("cell", "id").agg(F.count("*").alias("n"), *[F.min(F.xxhash64("x", F.lit(j))).alias(f"m{j}") for j in range(PERMS)])
    rows = PERMS // BANDS
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{j}") for j in range(b * rows, (b + 1) * rows)]) for b in range(BANDS)])
    signed = least.select("cell", "id", "n", F.explode(bands).alias("band"))
    a, b = signed.alias("a"), signed.alias("b")
    may = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & may).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    s = nodes.select("id", "s")
    full = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    similarity = both / (F.size("sa") + F.size("sb") - both)
    near = full.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    same = sets.select("cell", F.xxhash64("s").alias("node"), "id").join(nodes.select("cell", "node", F.col("id").alias("first")), ["cell", "node"]).filter("id <> first")
    return near.unionByName(same.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id each id of ``pairs`` reaches, however many rounds that takes. Rounds are written to the checkpoint folder."""
    both = _checkpointed(pairs.select("a", "b"))
    both = both.union(both.select("b", "a")).distinct()
    label = both.select(F.col("a").alias("id")).distinct().withColumn("cluster", F.col("id"))
    while True:
        heard = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("cluster").alias("heard"))
        near = label.join(heard, F.col("id") == F.col("a")).select("id", F.least("cluster", "heard").alias("to"), F.col("cluster").alias("was"))
        # Then each label takes its own label's: paths halve every round.
        root = near.select(F.col("id").alias("r"), F.col("to").alias("up"))
        moved = _checkpointed(near.join(root, F.col("to") == F.col("r")).select("id", F.least("to", "up").alias("cluster"), "was"))
        label = moved.select("id", "cluster")
        if moved.filter("cluster <> was").isEmpty():
            return label


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def near_clusters(records: DataFrame, key: str = "record_id", text: str = "text", cell: tuple[str, ...] = ("platform", "week_no"), threshold: float = THRESHOLD) -> DataFrame:
    """Each record with near_duplicate_cluster_id and is_near_duplicate.

    A cluster is named nd_{cell}_{number}: clusters of a cell are numbered from 001 in the order of
    their smallest ids. Texts under ten characters and records without a cell, or out of the calendar, are in none.
    """
    found = clusters(near_pairs(records, key, text, list(cell), threshold=threshold))
    of = records.select(key, *cell)
    first = found.filter("id = cluster").join(of, F.col("id") == F.col(key)).select("cluster", *cell)
    number = F.format_string("%03d", F.row_number().over(Window.partitionBy(*cell).orderBy("cluster")))
    named = first.select(F.col("cluster").alias("__cluster"), F.concat_ws("_", F.lit("nd"), *[F.col(c).cast("string") for c in cell], number).alias("near_duplicate_cluster_id"))
    joined = of.join(found.join(named, F.col("cluster") == F.col("__cluster")).select(F.col("id").alias(key), "near_duplicate_cluster_id"), key, "left")
    return joined.withColumn("is_near_duplicate", F.col("near_duplicate_cluster_id").isNotNull())


def near_statistics(clustered: DataFrame, cell: tuple[str, ...] = ("platform", "week_no")) -> DataFrame:
    """By cell: rows, clusters, clustered rows and the largest cluster."""
    per = clustered.groupBy(*cell, "near_duplicate_cluster_id").agg(F.count("*").alias("n"))
    known = F.col("near_duplicate_cluster_id").isNotNull()
    return per.groupBy(*cell).agg(F.sum("n").alias("n_rows"), F.count_if(known).alias("n_clusters"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_clustered"), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("largest_cluster"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The annotation that counts of each content and target: an ok one, then the latest."""
    order = Window.partitionBy("content_id", "target_id").orderBy(F.desc(F.col("annotation_status") == "ok"), F.desc_nulls_last("annotated_at"), F.desc("attempt"))
    return attempts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
