"""Event study: shares before and after registered events, and their variants.

Events and variants are one small broadcast table; records meet it once, in a
range condition on their time, and everything else is conditional counting.
Windows are half-open: [start, centre) and [centre, end).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.stats import difference
from weirflow.operators.trend import platforms


@dataclass(frozen=True)
class Event:
    event_id: str
    day: datetime
    target: str
    stance: str
    main_days: int
    narrow_days: int


#: The registry of this repository's window.
EVENTS = (
    Event("EV-1", datetime(2024, 1, 10, tzinfo=UTC), "T0", "support", 7, 3),
    Event("EV-2", datetime(2024, 1, 16, tzinfo=UTC), "T1", "support", 10, 5),
    Event("EV-3", datetime(2024, 1, 22, tzinfo=UTC), "T2", "oppose", 7, 3),
)
PLACEBO_DAYS = -5


def variants(spark: SparkSession, events=EVENTS, placebo_days: int = PLACEBO_DAYS) -> DataFrame:
    """A row for each event and variant: main, narrow window, without near-duplicates, without the largest source, placebo."""
    rows = []
    for e in events:
        for name, days, no_dup, no_top, shift in (("main", e.main_days, False, False, 0), ("narrow_window", e.narrow_days, False, False, 0), ("excl_near_dup", e.main_days, True, False, 0), ("excl_top_source", e.main_days, False, True, 0), ("placebo", e.main_days, False, False, placebo_days)):
            centre = e.day + timedelta(days=shift)
            rows.append((e.event_id, name, e.target, e.stance, days, no_dup, no_top, centre - timedelta(days=days), centre, centre + timedelta(days=days)))
    return spark.createDataFrame(rows, "event_id string, variant string, event_target string, stance string, window_days int, no_dup boolean, no_top boolean, t0 timestamp, t1 timestamp, t2 timestamp")


def variants_sql(events=EVENTS, placebo_days: int = PLACEBO_DAYS) -> str:
    rows = []
    for e in events:
        for name, days, no_dup, no_top, shift in (("main", e.main_days, "false", "false", 0), ("narrow_window", e.narrow_days, "false", "false", 0), ("excl_near_dup", e.main_days, "true", "false", 0), ("excl_top_source", e.main_days, "false", "true", 0), ("placebo", e.main_days, "false", "false", placebo_days)):
            c = e.day + timedelta(days=shift)
            t = [f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'" for x in (c - timedelta(days=days), c, c + timedelta(days=days))]
            rows.append(f"('{e.event_id}', '{name}', '{e.target}', '{e.stance}', {days}, {no_dup}, {no_top}, {', '.join(t)})")
    return "(VALUES " + ", ".join(rows) + ") AS v(event_id, variant, event_target, stance, window_days, no_dup, no_top, t0, t1, t2)"


def before_after(records: DataFrame, events=EVENTS, placebo_days: int = PLACEBO_DAYS) -> DataFrame:
    """Per event, variant and platform: shares before and after, their difference with its interval, and four counts."""
    spark = records.sparkSession
    ok = records.filter((F.col("annotation_status") == "ok"))
    per = ok.filter(F.col("source_container").isNotNull()).groupBy("platform", "source_container").agg(F.count("*").alias("n"))
    top = per.groupBy("platform").agg(F.min(F.struct((-F.col("n")).alias("less"), "source_container")).alias("t")).select("platform", F.col("t.source_container").alias("top_source"))
    v = F.broadcast(variants(spark, events, placebo_days))
    rows = ok.filter(F.col("created_at").isNotNull()).join(F.broadcast(top), "platform", "left").select("platform", "created_at", "target", "stance_label", "is_near_duplicate", "source_container", "top_source")
    keep = (~F.col("no_dup") | ~F.coalesce("is_near_duplicate", F.lit(False))) & (~F.col("no_top") | F.col("top_source").isNull() | (F.coalesce("source_container", F.lit("")) != F.col("top_source")))
    joined = rows.join(v, (F.col("created_at") >= F.col("t0")) & (F.col("created_at") < F.col("t2")) & keep)
    before, on = F.col("created_at") < F.col("t1"), F.col("target") == F.col("event_target")
    hit = on & (F.col("stance_label") == F.col("stance"))
    counts = joined.groupBy("event_id", "variant", "platform").agg(F.count_if(before).alias("n_before_all"), F.count_if(~before).alias("n_after_all"), F.count_if(before & on).alias("n_before_target"), F.count_if(~before & on).alias("n_after_target"), F.count_if(before & hit).alias("k_before"), F.count_if(~before & hit).alias("k_after"))
    names = ["n_before_all", "n_after_all", "n_before_target", "n_after_target", "k_before", "k_after"]
    full = v.select("event_id", "variant", "window_days", "stance").crossJoin(F.broadcast(platforms(records))).join(counts, ["event_id", "variant", "platform"], "left").select("event_id", "variant", "window_days", "stance", "platform", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    d = difference(F.col("k_before"), F.col("n_before_target"), F.col("k_after"), F.col("n_after_target"))
    return full.select("event_id", "variant", "platform", "window_days", "stance", *[F.round(x, 6).alias(c) for c, x in d.items()], *names[:4])


def composition(records: DataFrame, events=EVENTS) -> DataFrame:
    """Records of each platform before and after each event, and their share of the window."""
    v = F.broadcast(variants(records.sparkSession, events).filter("variant = 'main'"))
    ok = records.filter((F.col("annotation_status") == "ok") & F.col("created_at").isNotNull()).select("platform", "created_at")
    side = F.when(F.col("created_at") < F.col("t1"), "before").otherwise("after")
    counts = ok.join(v, (F.col("created_at") >= F.col("t0")) & (F.col("created_at") < F.col("t2"))).groupBy("event_id", side.alias("side"), "platform").agg(F.count("*").alias("n_records"))
    sides = records.sparkSession.createDataFrame([("before",), ("after",)], "side string")
    full = v.select("event_id").crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(platforms(records))).join(counts, ["event_id", "side", "platform"], "left").select("event_id", "side", "platform", F.coalesce("n_records", F.lit(0)).alias("n_records"))
    from pyspark.sql import Window

    total = F.sum("n_records").over(Window.partitionBy("event_id", "side"))
    return full.withColumn("total_records_in_window", total).withColumn("platform_share", F.round(F.try_divide(F.col("n_records"), F.col("total_records_in_window")), 6))


def anchor(records: DataFrame, day: datetime = datetime(2024, 1, 3, tzinfo=UTC), days: int = 14) -> DataFrame:
    """Label shares of the days after the study anchor; there is nothing before it."""
    ok = records.filter((F.col("annotation_status") == "ok") & (F.col("created_at") >= F.lit(day)) & (F.col("created_at") < F.lit(day + timedelta(days=days))))
    shares = {"negative_sentiment_share": F.col("sentiment_label") == "negative", "anger_share": F.col("emotion_label") == "anger", "fear_share": F.col("emotion_label") == "fear"}
    counts = ok.groupBy("platform").agg(F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(name) for name, c in shares.items()])
    return F.broadcast(platforms(records)).join(counts, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("n_records"), *shares)
