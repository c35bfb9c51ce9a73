"""Tables written in the shared folder, to cut lineage between passes.

Executors can be lost at any time, so what a later pass reads again lies in the
folder that ``spark.checkpoint.dir`` names and never on one machine's disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from weirflow.session import shared_dir

#: Rows and bytes in one Arrow batch; whole texts travel in them, so fewer than Spark's 10,000 rows.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


#: The working tables of the operators that run now, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile are deleted at the end, but for those written with ``keep``."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        drop(spark, paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", codec: str = "zstd", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; with ``keep`` it outlives the innermost ``scratch``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _open.get()[: -1 if keep else None][-1:]:
        paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
