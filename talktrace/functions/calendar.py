"""Day indexes and relative time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SECONDS_PER_DAY = 86_400

# The relative windows, smallest first, in seconds.
RECENCY_WINDOWS = (
    ("hour", 3_600),
    ("day", 86_400),
    ("week", 604_800),
    ("month", 2_678_400),
    ("year", 31_536_000),
)


def day_index(epoch: Column, origin_epoch: int) -> Column:
    """1-based day since the origin; a time before the origin has an index of 0 or less."""
    return (F.floor((epoch - F.lit(origin_epoch)) / F.lit(SECONDS_PER_DAY)) + 1).cast("int")


def recency_bucket(start: Column, now: Column) -> Column:
    """Name of the smallest relative window before `now` that contains `start` (epoch seconds)."""
    fits = [F.when(start >= now - F.lit(size), F.lit(name)) for name, size in RECENCY_WINDOWS]
    return F.coalesce(*fits, F.lit("all"))


def within_days(frame: DataFrame, first: int | None, last: int | None, day: str = "day") -> DataFrame:
    """Rows of the inclusive day range; a missing bound is open."""
    if first is not None:
        frame = frame.where(F.col(day) >= first)
    if last is not None:
        frame = frame.where(F.col(day) <= last)
    return frame


def after_and_before(frame: DataFrame, column: str, after: Column, before: Column | None = None) -> DataFrame:
    """Rows strictly between two moments, the second optional. Plain comparisons, so both reach the scan."""
    frame = frame.where(F.col(column) > after)
    return frame if before is None else frame.where(F.col(column) < before)


def local_day_index(epoch: Column, zone: str, origin: str) -> Column:
    """1-based day since the date `origin`, by the calendar of a named zone; days there may have 23 or 25 hours."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)
    return (F.datediff(local, F.lit(origin).cast("date")) + 1).cast("int")


def local_day_hours(day: Column, zone: str, origin: str) -> Column:
    """How many hours a local day has: 24, or another number where the zone's offset changes."""
    first = F.date_add(F.lit(origin).cast("date"), day - 1).cast("timestamp")
    after = F.date_add(F.lit(origin).cast("date"), day).cast("timestamp")
    start, end = (F.unix_timestamp(F.to_utc_timestamp(t, zone)) for t in (first, after))
    return ((end - start) / 3600).cast("int")
