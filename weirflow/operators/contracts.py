"""Contracts and driver-side rules: the record schema, configuration, gates, small reports, synthetic rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.calendar import PROJECT, ProjectCalendar
from weirflow.functions.text import is_present, slug

RECORD = "text string, date string, source string, platform string, post_id string, content_id string, is_reply boolean, author_metadata struct<author_hash: string, author_channel_id: string, like_count: long, verified: boolean>"
REQUIRED = ("text", "date", "source", "platform")


def valid_record() -> Column:
    """All required fields are there and not blank."""
    out = is_present(F.col(REQUIRED[0]))
    for name in REQUIRED[1:]:
        out = out & is_present(F.col(name))
    return out


def to_json_lines(records: DataFrame) -> DataFrame:
    """One JSON text a record, letters beyond ASCII as they are."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


@dataclass(frozen=True)
class TopicConfig:
    topic: str
    start: date
    end: date

    @classmethod
    def load(cls, raw: dict, today: date | None = None) -> TopicConfig:
        """A checked configuration; ``auto`` as end is today. Raises ValueError, naming what is wrong."""
        if not raw.get("topic"):
            raise ValueError("topic is missing")
        span = raw.get("date_range") or {}
        if not span.get("start"):
            raise ValueError("date_range.start is missing")
        start = date.fromisoformat(str(span["start"]))
        last = span.get("end", "auto")
        end = (today or datetime.now(UTC).date()) if last in (None, "auto") else date.fromisoformat(str(last))
        if end < start:
            raise ValueError(f"date_range ends ({end}) before it starts ({start})")
        return cls(str(raw["topic"]), start, end)


def topic_id(topic: Column) -> Column:
    return slug(topic)


def decision_gate(scorecard: list[dict], least_coverage: float = 0.9, most_failures: float = 0.1) -> tuple[str | None, dict[str, str]]:
    """The cheapest route whose coverage and failures are acceptable, and why the others are not."""
    reasons = {}
    for r in scorecard:
        if r["coverage"] < least_coverage:
            reasons[r["route"]] = f"coverage {r['coverage']:.3f} is under {least_coverage}"
        elif r["failure_rate"] > most_failures:
            reasons[r["route"]] = f"failure rate {r['failure_rate']:.3f} is over {most_failures}"
    fit = [r for r in scorecard if r["route"] not in reasons]
    return (min(fit, key=lambda r: (r["cost_per_1000"], r["route"]))["route"] if fit else None), reasons


def cost_allows(spent: float, next_cost: float, cap: float) -> bool:
    return spent + next_cost <= cap


def registry_problems(rows: list[dict], key: str, required: tuple[str, ...]) -> list[str]:
    """Repeated keys and missing fields of a registry."""
    seen: set = set()
    out = []
    for r in rows:
        if r.get(key) in seen:
            out.append(f"{key} {r.get(key)} is repeated")
        seen.add(r.get(key))
        out += [f"{key} {r.get(key)}: {c} is missing" for c in required if not r.get(c)]
    return out


def require_one_to_one(left: DataFrame, right: DataFrame, *keys: str) -> None:
    """Fails if the right side repeats a key, or lacks one of the left's."""
    again = right.groupBy(*keys).count().filter("count > 1").limit(1).count()
    lost = left.join(right, list(keys), "left_anti").limit(1).count()
    if again or lost:
        raise ValueError("the right side repeats a key" if again else "a key has no match")


def markdown(title: str, df: DataFrame, most: int = 50) -> str:
    """A small result as a Markdown section; the first ``most`` rows in its own order."""
    rows = df.limit(most).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def synthetic_records(spark: SparkSession, n: int, seed: int = 1405, calendar: ProjectCalendar = PROJECT, gap: tuple[str, str] = ("reddit", "W02")) -> DataFrame:
    """Made-up annotated records, marked is_synthetic, with one empty cell and one in twenty without a time."""
    seconds = int((calendar.end - calendar.start).total_seconds())
    u = lambda k: F.rand(seed + k)
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (u(k) * len(names)).cast("int") + 1)
    rows = spark.range(n).select(F.concat(F.lit("syn-"), F.col("id").cast("string")).alias("content_id"), pick(1, "x", "reddit", "youtube").alias("platform"), F.when(u(2) >= 0.05, F.timestamp_seconds(F.lit(int(calendar.start.timestamp())) + (u(3) * seconds).cast("long"))).alias("created_at"), pick(4, "positive", "negative", "neutral").alias("sentiment_label"), F.when(u(5) < 0.1, "api_failure").otherwise("ok").alias("annotation_status"), F.lit(True).alias("is_synthetic"))
    return rows.withColumn("project_week", calendar.week(F.col("created_at"))).filter(~((F.col("platform") == gap[0]) & (F.col("project_week") == gap[1])))
