"""Mentions after an entity's exit, by the number of days since."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import within_days
from ..functions.labels import AVERAGE
from .daily import dense_series
from .roster import keep_entities

# Fixed value: the default number of days considered.
MAX_OFFSET = 7


def offset_cells(
    daily: DataFrame, exits: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """(entity, offset, value) of the given exits, which should be few, on every active day, zeros included."""
    series = dense_series(daily, exits.select("entity"), first, last)
    offset = (F.col("day") - F.col("leave_day")).alias("offset")
    return series.join(exits, "entity").select("entity", offset, "value")


def post_exit_daily(
    daily: DataFrame,
    exits: DataFrame,
    picked: DataFrame,
    first: int | None = None,
    last: int | None = None,
    max_offset: int = MAX_OFFSET,
) -> DataFrame:
    """(entity, offset, value) of the picked entities for 1..max_offset days after their exit."""
    cells = offset_cells(daily, keep_entities(exits, picked), first, last)
    return cells.where(F.col("offset").between(1, max_offset))


def _by_offset(
    daily: DataFrame, exits: DataFrame, first: int | None, last: int | None, max_offset: int | None, picked: DataFrame | None = None
) -> DataFrame:
    """offset, mean, std over all (active day, exited entity) at that offset, and the picked ones as `own`.

    Nothing is filled out for the average: present values are folded by day and leave day, and how many
    are absent follows from the exits counted by leave day. Both are bounded by the calendar. Only the
    picked entities get a cell for each of their days.
    """
    marks = exits.select("entity", "leave_day")
    if picked is not None:
        marks = marks.join(picked.select("entity").distinct().withColumn("is_picked", F.lit(True)), "entity", "left")
    else:
        marks = marks.withColumn("is_picked", F.lit(None).cast("boolean"))
    cell = F.struct("entity", F.col("n").cast("double").alias("value"))
    folded = within_days(daily, first, last).join(marks, "entity", "left").groupBy("day", "leave_day").agg(
        F.count("n").alias("k"), F.avg("n").alias("m"), F.var_pop("n").alias("v"),
        F.collect_list(F.when(F.col("is_picked"), cell)).alias("own"),
    )
    part = F.when(F.col("leave_day").isNotNull(), F.struct("leave_day", "k", "m", "v"))
    days = folded.groupBy("day").agg(F.collect_list(part).alias("parts"), F.flatten(F.collect_list("own")).alias("own"))
    counted = exits.groupBy("leave_day").agg(F.count("*").alias("left"))
    leaves = counted.agg(F.collect_list(F.struct("leave_day", "left"))).scalar()  # one for each day of the calendar
    wanted = marks.where("is_picked").agg(F.collect_list(F.struct("entity", "leave_day"))).scalar()  # the picked alone
    nobody = F.lit(None).cast("string").alias("entity"), F.lit(None).cast("double").alias("value")
    nothing = F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("struct<k: bigint, m: double, v: double>").alias("part")

    def population(leave):
        found = F.filter("parts", lambda p: p["leave_day"] == leave["leave_day"])
        present = F.try_element_at(found, F.lit(1))
        moments = F.struct(*[F.coalesce(present[c], F.lit(0).cast(t)).alias(c) for c, t in (("k", "bigint"), ("m", "double"), ("v", "double"))])
        return F.struct((F.col("day") - leave["leave_day"]).alias("offset"), *nobody, leave["left"].alias("left"), moments.alias("part"))

    def shown(member):
        found = F.filter("own", lambda c: c["entity"] == member["entity"])
        value = F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(0.0))
        return F.struct((F.col("day") - member["leave_day"]).alias("offset"), member["entity"].alias("entity"), value.alias("value"), *nothing)

    days = days.select("*", leaves.alias("leaves"), wanted.alias("wanted"))
    cells = F.concat(F.transform("leaves", population), F.transform("wanted", shown)).alias("cells")
    placed = days.select(cells).select(F.inline("cells"))
    if max_offset is not None:
        placed = placed.where(F.col("offset").between(1, max_offset))
    none = F.lit(None).cast("double")
    own = F.when(F.col("entity").isNotNull(), F.struct("entity", "value", none.alias("std")))
    per_offset = placed.groupBy("offset").agg(
        F.sum("left").cast("double").alias("size"), F.collect_list("part").alias("parts"), F.collect_list(own).alias("own")
    )

    def total(value):
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + value(p))

    mean = total(lambda p: p["k"] * p["m"]) / F.col("size")
    absent = F.col("size") - total(lambda p: p["k"].cast("double"))
    gap = lambda p: p["m"] - F.col("mean")
    squares = total(lambda p: p["k"] * (p["v"] + gap(p) * gap(p))) + absent * F.col("mean") * F.col("mean")
    std = F.when(F.col("size") > 1, F.sqrt(squares / (F.col("size") - 1)))
    return per_offset.withColumn("mean", mean).select("offset", "mean", std.alias("std"), "own")


def post_exit_spread(
    daily: DataFrame,
    exits: DataFrame,
    entities: DataFrame,
    first: int | None = None,
    last: int | None = None,
    max_offset: int | None = MAX_OFFSET,
    extra_days: int = 0,
) -> DataFrame:
    """Mean and std per offset over all entities of the dictionary that left, quiet days being zeros."""
    end = None if last is None else last + extra_days
    return _by_offset(daily, keep_entities(exits, entities), first, end, max_offset).select("offset", "mean", "std")


def post_exit_with_average(
    daily: DataFrame,
    exits: DataFrame,
    picked: DataFrame,
    entities: DataFrame,
    first: int | None = None,
    last: int | None = None,
    max_offset: int = MAX_OFFSET,
) -> DataFrame:
    """The picked series followed by the mean over all entities; only the mean has a std. Both come from one pass."""
    per_offset = _by_offset(daily, keep_entities(exits, entities), first, last, max_offset, picked)
    average = F.struct(F.lit(AVERAGE).alias("entity"), F.col("mean").alias("value"), "std")
    rows = F.concat("own", F.array(average)).alias("rows")
    return per_offset.select("offset", rows).select("offset", F.inline("rows"))


def post_exit_totals(series: DataFrame) -> DataFrame:
    """Sum over the offsets per entity."""
    return series.groupBy("entity").agg(F.sum("value").alias("total"))
