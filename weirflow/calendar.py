"""The project calendar: a fixed window of seven-day weeks, the last one partial.

A record outside the window, or without a time, is kept and labelled ``OUT``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_MICROS = 7 * 86400 * 1_000_000
OUT = "OUT"


@dataclass(frozen=True)
class ProjectCalendar:
    start: datetime
    end: datetime  # inclusive

    @property
    def labels(self) -> list[str]:
        return [f"W{k + 1:02d}" for k in range((self.end - self.start) // timedelta(days=7) + 1)]

    @property
    def partial(self) -> str | None:
        """The last week if it is shorter than seven days."""
        return self.labels[-1] if (self.end + timedelta(seconds=1) - self.start) % timedelta(days=7) else None

    def _micros(self, t: datetime) -> int:
        return int(t.timestamp()) * 1_000_000

    def week(self, ts: Column) -> Column:
        """Week label of a timestamp, ``OUT`` beyond the window or when null."""
        t = F.unix_micros(ts)
        number = F.floor((t - self._micros(self.start)) / WEEK_MICROS) + 1
        inside = (t >= self._micros(self.start)) & (t <= self._micros(self.end))
        return F.when(inside, F.format_string("W%02d", number)).otherwise(OUT)

    def week_sql(self, ts: str) -> str:
        """The same in DuckDB's SQL."""
        t, start = f"epoch_us({ts})", self._micros(self.start)
        return f"CASE WHEN {t} BETWEEN {start} AND {self._micros(self.end)} THEN 'W' || lpad(CAST(CAST(floor(({t} - {start}) / {WEEK_MICROS}.0) AS BIGINT) + 1 AS VARCHAR), 2, '0') ELSE '{OUT}' END"

    def bounds(self, label: str) -> tuple[datetime, datetime]:
        """Start and end (exclusive) of a week; the last is cut at the window's end."""
        k = self.labels.index(label)
        start = self.start + timedelta(days=7 * k)
        return start, min(start + timedelta(days=7), self.end + timedelta(seconds=1))

    def weeks(self, spark: SparkSession) -> DataFrame:
        """(project_week, is_partial_week, week_start, week_end): a row for each week."""
        return spark.createDataFrame([(w, w == self.partial, *self.bounds(w)) for w in self.labels], "project_week string, is_partial_week boolean, week_start timestamp, week_end timestamp")

    def weeks_sql(self) -> str:
        return "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {str(w == self.partial).lower()})" for w in self.labels) + ") AS w(project_week, is_partial_week)"


#: The window of the records that this repository's queries run on.
PROJECT = ProjectCalendar(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 30, 23, 59, 59, tzinfo=UTC))
