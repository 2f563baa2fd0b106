"""Timeline events: one input row per event and entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import within_days
from .roster import keep_entities


def event_type_days(events: DataFrame) -> DataFrame:
    """Distinct (type, day)."""
    return events.select("type", "day").distinct()


def event_entities(
    events: DataFrame, picked: DataFrame | None = None, first: int | None = None, last: int | None = None
) -> DataFrame:
    """One row per event with its entities; both filters apply before grouping.

    Repeated rows of one entity are folded into `rows`, parallel to `entities`, so a list is never
    longer than the dictionary of entities, however many rows an event has.
    """
    kept = within_days(events, first, last)
    if picked is not None:
        kept = keep_entities(kept, picked)
    folded = kept.groupBy("type", "summary", "day", "entity").agg(F.count("*").alias("n"))
    listed = folded.groupBy("type", "summary", "day").agg(
        F.sort_array(F.collect_list(F.struct("entity", "n"))).alias("members")
    )
    return listed.select(
        "day",
        "type",
        "summary",
        F.col("members.entity").alias("entities"),
        F.col("members.n").alias("rows"),
    )


def event_markers(events: DataFrame, types: Sequence[str], first: int, last: int) -> DataFrame:
    """Events of the chosen types in the day range, with their number of rows."""
    chosen = within_days(events, first, last).where(F.col("type").isin(list(types)))
    return chosen.groupBy("type", "day", "summary").agg(F.count("*").alias("n"))


def day_digest_rows(events: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct (day, type, summary) for each day of the range; a day without events has one null row."""
    spine = events.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("day"))
    distinct = within_days(events, first, last).select("day", "type", "summary").distinct()
    empty = spine.join(distinct.select("day").distinct(), "day", "left_anti")
    nothing = [F.lit(None).cast(distinct.schema[c].dataType).alias(c) for c in ("type", "summary")]
    return distinct.where("day IS NOT NULL").unionByName(empty.select("day", *nothing))


def day_digest(events: DataFrame, first: int, last: int) -> DataFrame:
    """Types and summaries of each day, joined to one text each; null where nothing happened.

    The texts hold each distinct summary of a day; `day_digest_rows` is the same without joining
    them, for timelines where that is too much for one value.
    """
    rows = day_digest_rows(events, first, last)
    return rows.groupBy("day").agg(
        F.sort_array(F.collect_set("type")).alias("types"),
        F.sort_array(F.collect_set("summary")).alias("summaries"),
    ).select(
        "day",
        F.when(F.size("types") > 0, F.array_join("types", ", ")).alias("types"),
        F.when(F.size("summaries") > 0, F.array_join("summaries", "\n")).alias("summaries"),
    )


def day_events(days: DataFrame, events: DataFrame) -> DataFrame:
    """Every active day (day, value) with its events; a day without one keeps a null event.

    The events meet the small table of days by an inner join, in which a busy day can be split; days without
    events are added.
    """
    listed = event_entities(events)
    met = listed.join(days, "day")
    quiet = days.join(events.select("day").distinct(), "day", "left_anti")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in listed.schema if f.name != "day"]
    return met.unionByName(quiet.select("*", *nothing))
