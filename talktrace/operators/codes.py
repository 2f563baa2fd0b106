"""Dense integer codes of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir


def entity_codes(roster: DataFrame, row_order: str = "entry_day") -> DataFrame:
    """0-based position of each entity by (entry day, name); the first stint decides.

    The order is global but no task sorts everything: entities are range-partitioned by the sort
    key, numbered within their range, and shifted by the sizes of the ranges before. The partitioning
    is written out first, because it is sampled and must be the same for numbering and sizes.
    """
    ensure_checkpoint_dir(roster.sparkSession)
    first_stint = roster.groupBy("entity").agg(F.min_by("entry_day", row_order).alias("entry_day"))
    ranges = (
        first_stint.repartitionByRange("entry_day", "entity")
        .withColumn("range_no", F.spark_partition_id())
        .checkpoint()
    )
    sizes = ranges.groupBy("range_no").agg(F.count("*").alias("size"))
    # One row per partition, so ordering them in one window is cheap.
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range_no", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("range_no").orderBy("entry_day", "entity")
    numbered = ranges.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(offsets, "range_no").select(
        "entity", (F.col("shift") + F.col("place")).alias("code")
    )


def encode_pairs(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Replace x and y by the text "(code of x, code of y)"."""
    left = codes.select(F.col("entity").alias("x"), F.col("code").alias("code_x"))
    right = codes.select(F.col("entity").alias("y"), F.col("code").alias("code_y"))
    coded = pairs.join(left, "x").join(right, "y")
    others = [c for c in pairs.columns if c not in ("x", "y")]
    text = F.format_string("(%d, %d)", "code_x", "code_y")
    return coded.select(*others, text.alias("pair"))


def decode_pairs(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """Replace the text "(a, b)" by the entities with these codes, as x and y."""
    digits = r"^\((\d+), (\d+)\)$"
    others = [c for c in coded.columns if c != "pair"]
    parsed = coded.select(
        *others,
        *[F.regexp_extract("pair", digits, i).cast("bigint").alias(f"code_{c}") for i, c in ((1, "x"), (2, "y"))],
    )
    for side in ("x", "y"):
        names = codes.select(F.col("code").alias(f"code_{side}"), F.col("entity").alias(side))
        parsed = parsed.join(names, f"code_{side}")
    return parsed.select(*others, "x", "y")
