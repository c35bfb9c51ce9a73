"""Dates and times; what can not be parsed is null. Sessions are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_utc(c: Column) -> Column:
    """Only yyyy-mm-ddThh:mm:ssZ; fractions of a second are rejected."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def lenient_utc(c: Column) -> Column:
    """Any ISO form; without a zone it is UTC."""
    return F.try_to_timestamp(c)


def epoch_or_iso(c: Column) -> tuple[Column, Column]:
    """Epoch seconds, epoch milliseconds or ISO with a zone, and how it was read."""
    number = c.try_cast("double")
    status = F.when(c.isNull() | (F.trim(c) == ""), "missing").when((number >= 1e8) & (number < 1e11), "epoch_seconds").when((number >= 1e11) & (number < 1e14), "epoch_millis").when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(c).isNotNull(), "iso").otherwise("unparseable")
    ts = F.when(status == "epoch_seconds", F.timestamp_micros((number * 1e6).cast("long"))).when(status == "epoch_millis", F.timestamp_micros((number * 1e3).cast("long"))).when(status == "iso", F.try_to_timestamp(c))
    return ts, status


def unix_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_close_utc(day: Column, hour: int, minute: int, zone: str) -> Column:
    """A market's local closing time on a day, in UTC."""
    return F.to_utc_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(minute), F.lit(0)), zone)


def is_friday(day: Column) -> Column:
    return F.dayofweek(day) == 6


def iso_week(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("yearofweek"), c).cast("int"), F.weekofyear(c)))


def active_region(day: Column, groups: int) -> Column:
    """The group whose turn it is: the day's ordinal modulo the number of groups."""
    return F.pmod(F.datediff(day, F.lit("0001-01-01").cast("date")) + 1, F.lit(groups))


def active_on(day: Column, begin: Column, end: Column) -> Column:
    """begin <= day, and day <= end unless there is no end."""
    return (begin <= day) & (end.isNull() | (day <= end))
