"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Each works on every row that its predecessor kept:

1. toxicity: documents that the classifier chain rejects go;
2. near_dedup: of each group of near-duplicates the document of the smallest id stays;
3. decontaminate: documents that hold a benchmark item go;
4. mix: each document is there as often as the mix takes it, once, twice or not at all;
5. shard: each row gets its shard of the extendible hash directory.

Null and empty texts are clean, linked with nothing and of size 0, which the mix
takes no words of; they leave at the mix. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontam, minhash, mixing, sharding, toxicity
from weirflow.llm.store import drop, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: The mix draws at random by Spark's own hash and the toxicity stage fits a model; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one's is written; the last input stays, as the result reads it."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            drop(spark, before)
            before = [path]
    return docs
