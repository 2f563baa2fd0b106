"""Joins on time: the last row at or before a moment, and moments within spans.

Neither forms pairs that do not match beyond one cell of time, and neither needs a key: a key that holds all
rows, or no key at all, is split by time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

BUCKET = 3_600


def _known(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str,
    by: Sequence[str] = (),
    bucket: int = BUCKET,
    within: int | None = None,
) -> DataFrame:
    """Every row of `left` with the last row of `right` at or before its time, as `match`; null where there is none.

    Times are whole numbers; `by` names columns that must be equal on both sides. Of several right rows of one
    time and key the greatest by its values counts. `within` leaves out matches that are older. A null time or
    key matches nothing; repeated left rows stay.

    A key's rows are merged in order in buckets of time, each a group of its own. What a bucket takes over from
    those before it, the last row of the latest that has one, comes from one row per key and bucket: a
    window over the calendar, not over the rows. The right side is folded to one row per key and time
    and written to the checkpoint folder, because both its rows and its buckets are read from there.
    """
    keys = [f"key_{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    ensure_checkpoint_dir(right.sparkSession)
    match = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    folded = (
        right.where(_known(right_on, *by))
        .select(*named, F.col(right_on).cast("bigint").alias("time"), match.alias("match"))
        .groupBy(*keys, "time").agg(F.max("match").alias("match"))
        .checkpoint()
    )
    kind = folded.schema["match"].dataType
    place = F.floor(F.col("time") / F.lit(bucket)).cast("bigint").alias("bucket")
    rows = left.select(*named, F.col(on).cast("bigint").alias("time"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    able = rows.where(_known("time", *keys)).select("*", place)
    marks = folded.select("*", place)

    # One row per key and bucket: the last match in it, then the last one of the buckets before.
    ends = marks.groupBy(*keys, "bucket").agg(F.max_by("match", "time").alias("match"))
    asked = able.groupBy(*keys, "bucket").agg(F.lit(None).cast(kind).alias("match"))
    spine = ends.unionByName(asked).groupBy(*keys, "bucket").agg(F.first("match", ignorenulls=True).alias("match"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spine.select(*keys, "bucket", F.last("match", ignorenulls=True).over(before).alias("match"))

    nothing = F.lit(None).cast(rows.schema["row"].dataType)
    parts = (
        carried.where("match IS NOT NULL").select(*keys, "bucket", F.lit(None).cast("bigint").alias("time"), F.lit(0).alias("side"), "match", nothing.alias("row")),
        marks.select(*keys, "bucket", "time", F.lit(1).alias("side"), "match", nothing.alias("row")),
        able.select(*keys, "bucket", "time", F.lit(2).alias("side"), F.lit(None).cast(kind).alias("match"), "row"),
    )
    order = Window.partitionBy(*keys, "bucket").orderBy(F.col("time").asc_nulls_first(), "side")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = reduce(DataFrame.unionByName, parts).withColumn("found", F.last("match", ignorenulls=True).over(upto))
    found = F.col("found")
    if within is not None:
        found = F.when(F.col("time") - F.col(f"found.{right_on}") <= within, found)
    matched = merged.where("side = 2").select("row", found.alias("match"))
    unable = rows.where(~_known("time", *keys)).select("row", F.lit(None).cast(kind).alias("match"))
    return matched.unionByName(unable).select("row.*", "match")


def _cells(first: Column, after: Column, levels: int) -> Column:
    """The fewest aligned cells, of sizes 1, 2, 4, ..., that cover the cells from `first` to before `after`."""
    found = []
    for n in range(levels + 1):
        low, high = -F.shiftright(-first, n), F.shiftright(after, n)
        odd = [(low % 2 != 0, low), (high % 2 != 0, high - 1)]
        found += [F.when((low < high) & is_odd, F.struct(F.lit(n).alias("level"), cell.alias("cell"))) for is_odd, cell in odd]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def interval_join(
    points: DataFrame, spans: DataFrame, on: str, start: str, end: str, by: Sequence[str] = (), grain: int = 1
) -> DataFrame:
    """Pairs of a row of `points` and a row of `spans` that contains its time, both ends included: `point`, `span`.

    Times are whole numbers; a null start or end is open; a null time or key, and a span that ends before it
    starts, match nothing. `by` names columns that must be equal. Repeated rows are paired each.

    A span is covered by aligned cells of growing sizes, at most two of each size, so a long span is few rows
    whatever its length. A point lies in one cell of each size and meets a span in exactly one cell: an equi-join on
    key, size and cell, in which adaptive execution splits a busy cell. Cells are `grain` wide at least;
    the times themselves are compared in the cell. The driver sees the points' range and the sizes in use.
    """
    keys = [f"key_{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    timed = points.where(_known(on, *by)).select(
        *named, F.col(on).cast("bigint").alias("time"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"))
    low, high = timed.agg(F.min("time"), F.max("time")).first()
    low, high = (low, high) if low is not None else (0, -1)
    first = F.greatest(F.coalesce(F.col(start).cast("bigint"), F.lit(low)), F.lit(low))
    last = F.least(F.coalesce(F.col(end).cast("bigint"), F.lit(high)), F.lit(high))
    known = spans.where(_known(*by)) if by else spans
    ranged = known.select(
        *named, first.alias("first"), last.alias("last"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("span")
    ).where("first <= last")
    cell = F.floor(F.col("first") / grain).cast("bigint"), F.floor(F.col("last") / grain).cast("bigint") + 1
    levels = (high // grain - low // grain + 1).bit_length() if low <= high else 0
    covered = ranged.select(*keys, "first", "last", "span", F.explode(_cells(*cell, levels)).alias("at")).select(*keys, "first", "last", "span", "at.*")
    used = sorted(r[0] for r in covered.select("level").distinct().collect())  # at most 64 numbers
    if not used:
        used = [0]
    own = F.floor(F.col("time") / grain).cast("bigint")
    cells = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(own, n).alias("cell")) for n in used])
    placed = timed.select(*keys, "time", "point", F.explode(cells).alias("at")).select(*keys, "time", "point", "at.*")
    met = placed.join(covered, [*keys, "level", "cell"])
    return met.where("time BETWEEN first AND last").select("point", "span")


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, by: Sequence[str] = (), grain: int = 1) -> DataFrame:
    """Pairs of rows whose spans have a moment in common: `left`, `right`. Starts are known, ends may be open.

    Either the left span starts within the right one, or the right one starts within the left one and later.
    """
    into = interval_join(left, right, start, start, end, by, grain).select(F.col("point").alias("left"), F.col("span").alias("right"))
    closed = left.where(F.col(end).isNull() | (F.col(end) >= F.col(start)))
    over = interval_join(right, closed, start, start, end, by, grain).select(F.col("span").alias("left"), F.col("point").alias("right"))
    later = over.where(F.col(f"right.{start}") > F.col(f"left.{start}"))
    proper = F.col(f"left.{end}").isNull() | (F.col(f"left.{end}") >= F.col(f"left.{start}"))
    also = F.col(f"right.{end}").isNull() | (F.col(f"right.{end}") >= F.col(f"right.{start}"))
    return into.unionByName(later).where(proper & also)
