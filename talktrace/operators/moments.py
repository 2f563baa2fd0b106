"""High and low blocks of days.

The input is one row per active day. Days are bounded by the calendar, so ranking them in one
window is not a bottleneck at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The texts in which blocks are shown.
NOTHING_HAPPENED = "No main events happened"
ONE_DAY, FROM_DAY, TO_DAY, BULLET = "Day ", "Days ", " to ", "* "


def _blocks(days: DataFrame, block: Column, total: Column) -> DataFrame:
    grouped = days.withColumn("block", block.cast("int")).groupBy("block")
    return grouped.agg(F.sort_array(F.collect_list("day")).alias("days"), total.cast("double").alias("value"))


def ordinal_blocks(day_values: DataFrame, size: int) -> DataFrame:
    """Blocks of `size` consecutive active days, with the sum of their values."""
    order = F.row_number().over(Window.orderBy("day")) - 1
    return _blocks(day_values, F.floor(order / size), F.sum("value"))


def equal_width_blocks(day_values: DataFrame, size: int) -> DataFrame:
    """Blocks of equal calendar width, as many as `size` fits into the active days, with the mean value.

    Blocks are closed on the right and the first day belongs to the first block, in whole numbers.
    """
    everything = Window.partitionBy()
    placed = day_values.select(
        "day",
        "value",
        F.min("day").over(everything).alias("low"),
        F.max("day").over(everything).alias("high"),
        F.count("*").over(everything).alias("n"),
    )
    block = F.expr(
        f"CASE WHEN high = low THEN 0 ELSE greatest("
        f"((day - low) * greatest(n div {int(size)}, 1) + (high - low) - 1) div (high - low) - 1, 0) END"
    )
    return _blocks(placed, block, F.avg("value"))


def extremes(blocks: DataFrame, k: int = 3) -> DataFrame:
    """The k highest and k lowest blocks; nothing at all with fewer than k blocks. Ties: first day first."""
    start = F.col("days")[0]
    ranked = blocks.select(
        "days",
        "value",
        F.row_number().over(Window.orderBy(F.desc("value"), start)).alias("from_top"),
        F.row_number().over(Window.orderBy("value", start)).alias("from_bottom"),
        F.count("*").over(Window.partitionBy()).alias("n_blocks"),
    )
    sides = F.array(
        F.struct(F.lit("high").alias("side"), F.col("from_top").alias("rank")),
        F.struct(F.lit("low").alias("side"), F.col("from_bottom").alias("rank")),
    )
    return (
        ranked.where(F.col("n_blocks") >= k)
        .select(F.inline(sides), "days", "value")
        .where(F.col("rank") <= k)
    )


def moment_records(moments: DataFrame, events: DataFrame) -> DataFrame:
    """The distinct (event, entity) rows on the days of each moment.

    Made distinct before the join: a day with very many rows is folded where it is read.
    """
    days = moments.select("side", "rank", F.explode("days").alias("day"))
    facts = events.select("day", "type", "summary", "entity").distinct()
    return facts.join(days, "day").select("side", "rank", "day", "type", "summary", "entity")


def moment_details(moments: DataFrame, events: DataFrame) -> DataFrame:
    """What happened in each moment: day range, value, event types, summaries and entities involved.

    For display: each list is one value. `moment_records` has the same as rows, of any number.
    """
    facts = moment_records(moments, events).groupBy("side", "rank").agg(
        *[F.sort_array(F.collect_set(c)).alias(c) for c in ("type", "summary", "entity")]
    )
    first, last = F.array_min("days").cast("string"), F.array_max("days").cast("string")
    label = F.when(F.size("days") == 1, F.concat(F.lit(ONE_DAY), first)).otherwise(
        F.concat(F.lit(FROM_DAY), first, F.lit(TO_DAY), last)
    )
    summaries = F.when(
        F.size("summary") > 0, F.concat(F.lit(BULLET), F.array_join("summary", f"\n{BULLET}"))
    ).otherwise(F.lit(NOTHING_HAPPENED))
    nothing = F.array().cast("array<string>")
    return moments.join(facts, ["side", "rank"], "left").select(
        "side",
        "rank",
        label.alias("day_range"),
        F.round("value", 2).alias("value"),
        F.coalesce("type", nothing).alias("types"),
        F.coalesce(summaries, F.lit(NOTHING_HAPPENED)).alias("summaries"),
        F.coalesce("entity", nothing).alias("entities"),
    )
