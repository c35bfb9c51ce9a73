"""Incremental forms: watermarks, idempotent re-reads, windows, bursts and upserts on streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.operators.risk import BURST_ROWS, BURST_SECONDS


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


def new_contents(stream: DataFrame, key: str, ts: str, overlap: str) -> DataFrame:
    """Contents not seen before: re-reading the overlap behind the newest time changes nothing."""
    return stream.withWatermark(ts, overlap).dropDuplicatesWithinWatermark([key])


def weekly_counts(stream: DataFrame, ts: str, delay: str, *by: str) -> DataFrame:
    """Seven-day windows that start with the project's weeks (Mondays)."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", "7 days", "4 days"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week_start"), *by, "n")


def labelled_weeks(stream: DataFrame, ts: str, calendar: ProjectCalendar = PROJECT) -> DataFrame:
    """Each row with its week, or OUT: nothing is dropped for its time."""
    return stream.withColumn("project_week", calendar.week(F.col(ts)))


def bursts(stream: DataFrame, author: str, ts: str, key: str) -> DataFrame:
    """(key, author, burst_size): the author's last rows within a minute; state is their last few times.

    Rows of one micro-batch are taken in order of time; state never grows beyond the last ``BURST_ROWS`` - 1.
    """
    schema = f"{key} long, {author} string, burst_size int"

    def step(name, frames, state):
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([ts, key])
        out = []
        for k, micros in zip(rows[key], rows[ts].dt.tz_localize(None).astype("datetime64[us]").astype("int64"), strict=True):
            micros = int(micros)
            near = [x for x in last[-(BURST_ROWS - 1) :] if micros - x <= BURST_SECONDS * 1_000_000]
            out.append((k, name[0], len(near) + 1))
            last = [*last, micros][-(BURST_ROWS - 1) :]
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, author, "burst_size"])

    rows = stream.filter(F.col(author).isNotNull()).select(key, author, F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(author).applyInPandasWithState(step, schema, "times array<long>", "append", "NoTimeout")


def entity_watermarks(rows: DataFrame, previous: DataFrame | None, entity: str, ts: str) -> DataFrame:
    """(entity, watermark): the newest time seen of each, never going back."""
    new = rows.groupBy(entity).agg(F.max(ts).alias("watermark"))
    both = new if previous is None else new.unionByName(previous)
    return both.groupBy(entity).agg(F.max("watermark").alias("watermark"))


def global_watermark(rows: DataFrame, ts: str, overlap_seconds: int, previous=None) -> DataFrame:
    """The newest time less the overlap, not before ``previous``."""
    mark = F.max(ts) - F.make_dt_interval(secs=F.lit(overlap_seconds))
    return rows.agg((mark if previous is None else F.greatest(mark, F.lit(previous))).alias("watermark"))


def merge_upsert(stored: DataFrame, batch: DataFrame, key: str, ids: str, metrics: tuple[str, ...], order: str) -> DataFrame:
    """Insert, or merge: ids are united, metrics take the latest that is not null, the rest stays as first seen."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    united = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.coalesce(ids, F.lit("")), ";"))))), ";")
    fixed = [c for c in stored.columns if c not in (key, ids, *metrics)]
    return both.groupBy(key).agg(F.regexp_replace(united, "^;", "").alias(ids), *[F.max_by(m, F.when(F.col(m).isNotNull(), F.struct("__new", order))).alias(m) for m in metrics], *[F.min_by(c, F.struct("__new", order)).alias(c) for c in fixed])


def upsert_sink(stream: DataFrame, path: str, key: str, ids: str, metrics: tuple[str, ...], order: str, checkpoint: str):
    """Each micro-batch merged into a new version of the table; the latest version is the one of the largest number."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A version that exists was written before a restart: the batch is done.
        last = f"{path}/v={number - 1}"
        stored = spark.read.parquet(last) if number else batch.limit(0)
        merge_upsert(stored, batch, key, ids, metrics, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_dense(counts: DataFrame, most: int) -> DataFrame:
    """(lo, hi, n): intervals of per-second counts (t, n) halved while they hold more than ``most`` rows and more than one second.

    Halving a fixed interval is choosing how many leading bits of the offset count, so all levels are one aggregate.
    """
    ends = counts.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends.a is None:
        return counts.sparkSession.createDataFrame([], "lo long, hi long, n long")
    top = int(ends.b - ends.a).bit_length()
    offsets = counts.select((F.col("t") - ends.a).cast("long").alias("o"), "n", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("j"))
    sums = offsets.groupBy("j", F.expr("shiftright(o, j)").alias("cell")).agg(F.sum("n").alias("n"))
    parents = sums.select((F.col("j") - 1).alias("j"), F.col("cell").alias("above"), F.col("n").alias("pn"))
    reached = sums.withColumn("above", F.shiftright("cell", 1)).join(parents, ["j", "above"], "left").filter((F.col("j") == top) | (F.col("pn") > most))
    fits = reached.filter((F.col("n") <= most) | (F.col("j") == 0))
    return fits.select((F.expr("shiftleft(cell, j)") + ends.a).alias("lo"), (F.expr("shiftleft(cell + 1, j)") + ends.a).alias("hi"), "n")


def first_matches(rows: DataFrame, *key: str, order: str) -> DataFrame:
    """INSERT OR IGNORE: the first row of each key stays."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
