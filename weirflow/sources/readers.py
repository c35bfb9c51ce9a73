"""Sources and sinks of the pipeline, all through Spark's readers and writers."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.funnel import TARGETS


def parquet_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet folders by column name, absent columns null, with source_file; unreadable files are skipped."""
    parts = [spark.read.option("ignoreCorruptFiles", "true").parquet(p) for p in paths]
    parts = [p.withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that do not parse (with their file); blank lines are skipped, unknown keys dropped."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("__v", F.try_parse_json("value")).withColumn("__r", F.from_json("value", kind))
    good = parsed.filter(F.col("__v").isNotNull()).select("__r.*", "source_file")
    return good, parsed.filter(F.col("__v").isNull()).select("value", "source_file")


def preferred_paths(spark: SparkSession, clean: str, patterns: list[str]) -> list[str]:
    """The clean file if it is there, else what each pattern finds, sorted within it, in the order of the patterns; through Spark's file systems."""
    conf = spark._jsc.hadoopConfiguration()

    def found(pattern: str) -> list[str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return sorted(s.getPath().toString() for s in at.getFileSystem(conf).globStatus(at) or ())

    at = spark._jvm.org.apache.hadoop.fs.Path(clean)
    return [clean] if at.getFileSystem(conf).exists(at) else [p for pattern in patterns for p in found(pattern)]


def preferred_records(spark: SparkSession, clean: str, patterns: list[str], schema: str) -> DataFrame:
    """Records of the clean JSON lines, else of all raw ones; none where there are no files. A line that does not parse is left out."""
    paths = preferred_paths(spark, clean, patterns)
    if not paths:
        return spark.createDataFrame([], schema + ", source_file string")
    return reduce(DataFrame.unionByName, [jsonl(spark, p, schema)[0] for p in paths])


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON in either form: one document (array or object) a file, or one a line; the first character decides."""
    head = spark.read.option("wholetext", "true").text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("c"), (F.regexp_count(F.trim("value"), F.lit(r"\}\s*\n\s*\{")) > 0).alias("lines"))
    multi = head.agg(F.bool_and((F.col("c") == "[") | ~F.col("lines"))).first()[0]
    return spark.read.schema(schema).option("multiLine", str(bool(multi)).lower()).json(path)


def csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV as strings, "" as null, with a byte order mark before the first name removed."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    names = columns or clean.columns
    return clean.select(*[(F.nullif(F.col(f"`{c}`"), F.lit("")) if c in clean.columns else F.lit(None).cast("string")).alias(c) for c in names])


def _flatten(post: dict) -> list[tuple]:
    """Comments of a two-part listing, in order, with depth, root and path; stubs for what was not loaded."""
    rows: list[tuple] = []
    todo = [(child, None, 0, None, "") for child in reversed(post[1]["data"]["children"])] if isinstance(post, list) and len(post) > 1 else []
    while todo:
        node, parent, depth, root, path = todo.pop()
        kind, data = node.get("kind"), node.get("data") or {}
        own = data.get("id")
        here = f"{path}/{own}"
        replies = data.get("replies")
        children = replies["data"]["children"] if isinstance(replies, dict) else []
        if kind == "more":
            rows.append((own, parent, depth, root, here, None, None, None, len(data.get("children") or []), True))
            continue
        rows.append((own, parent, depth, root or own, here, data.get("author"), data.get("body"), data.get("created_utc"), sum(c.get("kind") == "t1" for c in children), False))
        todo += [(c, own, depth + 1, root or own, here) for c in reversed(children)]
    return rows


_TREE = "comment_id string, parent_comment_id string, depth int, root_id string, thread_path string, author string, body string, created_utc double, direct_replies int, is_stub boolean, source_file string"


def comment_trees(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of recursive comment listings, one JSON document a file; files that do not parse give no rows.

    The recursion has no fixed schema, so the flattening is in Python, file by file.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(*row, name) for row in _flatten(json.loads(text))]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _TREE.split(", ")])

    files = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")
    return files.mapInArrow(run, _TREE)


def last_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each id; rows without an id all stay."""
    from pyspark.sql import Window

    known = F.col(key).isNotNull()
    surrogate = F.when(known, F.col(key).cast("string")).otherwise(F.uuid())
    w = Window.partitionBy("__k").orderBy(F.desc(order))
    return rows.withColumn("__k", surrogate).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__k", "__r")


def write_buckets(decided: DataFrame, path: str) -> None:
    """Parquet partitioned by dataset_target; targets without rows get an empty file, so all six can be read."""
    decided.write.mode("overwrite").partitionBy("dataset_target").parquet(path)
    found = {r[0] for r in decided.select("dataset_target").distinct().toLocalIterator()}  # six at most
    for target in set(TARGETS) - found:
        decided.limit(0).drop("dataset_target").write.mode("overwrite").parquet(f"{path}/dataset_target={target}")


def write_csv_bom(df: DataFrame, path: str) -> None:
    """A small result as one CSV file that starts with a byte order mark."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest]).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite(spark: SparkSession, path: str, transform) -> str:
    """The transformed rows in a new version beside ``path``; fails if the row count differs."""
    source = spark.read.parquet(path)
    target = f"{path.rstrip('/')}-v{uuid.uuid4().hex[:8]}"
    transform(source).write.parquet(target)
    before, after = source.count(), spark.read.parquet(target).count()
    if before != after:
        raise ValueError(f"{before} rows became {after}")
    return target


def html_payload(tables: dict[str, DataFrame]) -> str:
    """Small result tables as JSON for a page: numbers that are not finite as null, "</" escaped; texts stay as they are."""
    def finite(df: DataFrame) -> DataFrame:
        bad = F.array(F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("nan")))
        return df.select(*[F.when(~F.array_contains(bad, F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])

    rows = {name: finite(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator() for name, df in tables.items()}
    body = {name: [json.loads(r[0]) for r in found] for name, found in rows.items()}
    return json.dumps(body, ensure_ascii=False, allow_nan=False, default=str).replace("</", "<\\/")
