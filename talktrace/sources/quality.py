"""Row-level failure isolation: bad rows are kept aside and counted, good rows go on.

A row is bad if its record could not be read or its key is missing. Texts and numbers have no limits
beyond their types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CORRUPT, TableSpec

UNREADABLE = "record is unreadable"


def rejection(table: TableSpec, columns: list[str]) -> Column:
    """Reason why a row cannot be stored, null for a good row."""
    missing = F.when(F.col(table.key).isNull(), F.lit(f"{table.key} is null"))
    if CORRUPT not in columns:
        return missing
    return F.coalesce(F.when(F.col(CORRUPT).isNotNull(), F.lit(UNREADABLE)), missing)


@dataclass(frozen=True)
class CheckedRows:
    """Good rows in table order, bad rows with their `reason`."""

    accepted: DataFrame
    rejected: DataFrame


def check_rows(rows: DataFrame, table: TableSpec) -> CheckedRows:
    reason = rejection(table, rows.columns)
    return CheckedRows(
        rows.where(reason.isNull()).select(*table.column_names),
        rows.withColumn("reason", reason).where(F.col("reason").isNotNull()),
    )


def split_unreadable(rows: DataFrame) -> CheckedRows:
    """Rows of a reader that keeps unreadable records, by whether they were read.

    Readers convert, and so check, only the fields that a plan refers to; both sides refer to all of them.
    """
    nothing = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.lit("")) for c in rows.columns if c != CORRUPT])
    unreadable = F.concat_ws("", CORRUPT, nothing) != ""
    record = F.concat_ws("", CORRUPT, nothing)
    bad = rows.where(unreadable).select(F.lit(UNREADABLE).alias("reason"), record.alias("record"))
    return CheckedRows(rows.where(~unreadable).drop(CORRUPT), bad)


def load_summary(rows: DataFrame, table: TableSpec) -> DataFrame:
    """How many rows were accepted and how many rejected, by reason, in one pass."""
    reason = rejection(table, rows.columns)
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n_rows"))
