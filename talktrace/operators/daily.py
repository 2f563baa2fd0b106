"""Daily series per entity and their cross-entity statistics.

Series stay sparse: an entity without a mention on a day has no row. Statistics that count such
entities as zero add them arithmetically; only the display series is filled out, and only for the
picked entities on active days. A day is active if any entity of the dictionary is mentioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import within_days
from ..functions.labels import AVERAGE
from ..session import ensure_checkpoint_dir

# The range and default of the band's multiple.
BAND_MIN, BAND_MAX, BAND_DEFAULT = 0.05, 10.0, 2.0


def daily_mentions(rows: DataFrame) -> DataFrame:
    """Mentions per day and entity."""
    return rows.groupBy("day", "entity").agg(F.sum("n").alias("n"))


def _moments(value: str) -> list[Column]:
    """Count, mean and variance of the present values."""
    return [F.count(value).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v")]


def _mean_and_std(population: Column | int) -> tuple[Column, Column]:
    """Mean and sample deviation over `population` members from k, m, v; the absent ones are zeros.

    Combines the moments of the present values with those of the zeros, which stays accurate where
    a plain sum of squares would cancel, and needs no row for any zero.
    """
    total = F.lit(population).cast("double")
    k = F.col("k").cast("double")
    m, v = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("m", "v"))
    squares = v * k + m * m * k * (total - k) / total
    return m * k / total, F.when(total > 1, F.sqrt(squares / (total - 1)))


def spread(present: DataFrame, key: str, value: str, population: Column | int) -> DataFrame:
    """Mean and sample deviation per key across a population of which only some have a row."""
    mean, std = _mean_and_std(population)
    moments = present.groupBy(key).agg(*_moments(value))
    return moments.select(key, mean.alias("mean"), std.alias("std"))


def daily_spread(
    daily: DataFrame,
    population: Column | int,
    first: int | None = None,
    last: int | None = None,
    value: str = "n",
    extra_days: int = 0,
) -> DataFrame:
    """Per-day mean and std across all entities of the dictionary. `extra_days` prolongs the range."""
    end = None if last is None else last + extra_days
    return spread(within_days(daily, first, end), "day", value, population)


def band(stats: DataFrame, multiple: float = BAND_DEFAULT) -> DataFrame:
    """mean ± multiple · std."""
    if not BAND_MIN <= multiple <= BAND_MAX:
        raise ValueError(f"the multiple must lie in [{BAND_MIN}, {BAND_MAX}]")
    reach = F.lit(multiple) * F.col("std")
    return stats.withColumns({"lower": F.col("mean") - reach, "upper": F.col("mean") + reach})


def dense_series(
    daily: DataFrame,
    picked: DataFrame,
    first: int | None = None,
    last: int | None = None,
    value: str = "n",
    population: Column | int | None = None,
) -> DataFrame:
    """(day, entity, value) for every picked entity on every active day of the range, zeros included.

    With `population` the cross-entity mean follows as one more entity, as a double series.

    The missing entities are added inside one row per day, of the size of the selection. Joining
    the series with its own days instead would read and scan all texts a second time.
    """
    kind = "double" if population is not None else daily.schema[value].dataType.simpleString()
    cell = F.struct("entity", F.col(value).cast(kind).alias("value"))
    marked = _mark_picked(within_days(daily, first, last), picked)
    per_day = marked.groupBy("day").agg(
        F.collect_list(F.when(F.col("is_picked"), cell)).alias("own"), *_moments(value)
    )
    wanted = picked.agg(F.collect_set("entity")).scalar()
    missing = F.array_except(wanted, F.col("own.entity"))
    zeros = F.array_repeat(F.lit(0).cast(kind), F.size(missing))
    cells = F.concat("own", F.arrays_zip(missing.alias("entity"), zeros.alias("value")))
    if population is not None:
        mean = F.struct(F.lit(AVERAGE).alias("entity"), _mean_and_std(population)[0].alias("value"))
        cells = F.concat(cells, F.array(mean))
    return per_day.select("day", cells.alias("cells")).select("day", F.inline("cells"))


def dense_grid(
    daily: DataFrame, entities: DataFrame, first: int | None = None, last: int | None = None, value: str = "n"
) -> DataFrame:
    """As `dense_series`, for whole dictionaries: (day, entity, value) with zeros, by a join.

    Only the active days are held in one value, which the calendar bounds. The series is written to the
    checkpoint folder, so that the texts behind it are read once for both the days and the values.
    """
    ensure_checkpoint_dir(daily.sparkSession)
    kept = within_days(daily, first, last).checkpoint()
    days = kept.agg(F.collect_set("day")).scalar()
    grid = entities.select("entity").distinct().select("entity", days.alias("days"))
    placed = grid.select("entity", F.explode("days").alias("day"))
    zero = F.lit(0).cast(daily.schema[value].dataType)
    filled = placed.join(kept.select("day", "entity", value), ["day", "entity"], "left")
    return filled.select("day", "entity", F.coalesce(value, zero).alias("value"))


def with_average(series: DataFrame, stats: DataFrame) -> DataFrame:
    """Append the cross-entity mean, matched by day, as one more entity. For stored series and stats;
    `dense_series` adds the mean in the same pass."""
    average = stats.select("day", F.lit(AVERAGE).alias("entity"), F.col("mean").alias("value"))
    return series.withColumn("value", F.col("value").cast("double")).unionByName(average)


def without_average(series: DataFrame) -> DataFrame:
    return series.where(F.col("entity") != AVERAGE)


def wide_to_long(wide: DataFrame, value: str, first: int, last: int, include_average: bool = True) -> DataFrame:
    """A matrix with one column per entity (and `day`) to (day, entity, value) rows of a day range."""
    entities = [c for c in wide.columns if c != "day"]
    long = within_days(wide, first, last).unpivot("day", entities, "entity", value)
    return long if include_average else without_average(long)


def entity_totals(
    daily: DataFrame, picked: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Total mentions of each picked entity in the range, 0 if there are none."""
    totals = within_days(daily, first, last).groupBy("entity").agg(F.sum("n").alias("total"))
    return picked.select("entity").join(totals, "entity", "left").select(
        "entity", F.coalesce("total", F.lit(0)).alias("total")
    )


def _mark_picked(daily: DataFrame, picked: DataFrame) -> DataFrame:
    marks = picked.select("entity").distinct().withColumn("is_picked", F.lit(True))
    return daily.join(marks, "entity", "left")


def day_totals(
    daily: DataFrame, picked: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Mentions of all picked entities per active day; a day on which only others are mentioned has 0."""
    counted = F.when(F.col("is_picked"), F.col("n")).otherwise(F.lit(0))
    return (
        _mark_picked(within_days(daily, first, last), picked)
        .groupBy("day")
        .agg(F.sum(counted).alias("value"))
    )
