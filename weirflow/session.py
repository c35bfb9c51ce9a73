"""One place for session settings; everything else takes the session it is given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, as in tests, one beside the warehouse, which executors share too."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weirflow"
    return known.rstrip("/")


def build_session(app: str = "weirflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has further settings, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
