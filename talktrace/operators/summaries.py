"""Aggregates that merge: value histograms with percentiles, distinct counts, cubes; and trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def value_histogram(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, value, n): how often each value occurs. Histograms of parts merge by summing n."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def merged(histograms: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same with fewer keys."""
    return histograms.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def percentiles(histograms: DataFrame, by: Sequence[str], percents: Sequence[int] = (50, 90)) -> DataFrame:
    """(by, n, p50, p90, ...): the least value that so many percent of the rows do not exceed. Exact.

    A window runs over the distinct values of a key, not over its rows.
    """
    own = Window.partitionBy(*by)
    upto = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = merged(histograms, by).select(*by, "value", "n", upto.alias("upto"), F.sum("n").over(own).alias("total"))
    found = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("value"))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), *found)


# Binary logarithm of a sketch's registers; the relative error is about 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 14


def distinct_sketches(rows: DataFrame, value: str, by: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """(by, sketch): a mergeable sketch of the distinct values, to be stored by day and key."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, estimate): the number of distinct values over all merged sketches of a key; no texts are read."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def cube_counts(rows: DataFrame, dimensions: Sequence[str], measure: str, distinct: str) -> DataFrame:
    """Totals of `measure` and exact distinct counts of `distinct` for every subset of the dimensions, in one pass.

    A dimension that is summed over is null; `level` has a bit for each, the first dimension's being the highest.
    Rows are folded to one per cell and distinct value before they are dealt to the levels, so the copies per level
    are of that size.
    """
    folded = rows.groupBy(*dimensions, distinct).agg(F.sum(measure).alias("n"))
    return folded.cube(*dimensions).agg(
        F.grouping_id(*dimensions).alias("level"), F.sum("n").alias("n"), F.count_distinct(distinct).alias("distinct"))


def trailing(series: DataFrame, value: str = "n", days: int = 7) -> DataFrame:
    """Each row of a sparse series (day, entity, value) with `mean`, of the last `days` calendar days, and `change`, against
    the mean of as many days before those. Absent days count as zero and need no row.
    """
    by_day = Window.partitionBy("entity").orderBy("day")
    now = F.sum(value).over(by_day.rangeBetween(-(days - 1), 0)) / days
    before = F.coalesce(F.sum(value).over(by_day.rangeBetween(-(2 * days - 1), -days)), F.lit(0)) / days
    return series.select("*", now.alias("mean"), (now - before).alias("change"))
