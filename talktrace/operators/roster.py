"""Roster cleaning, cohorts, selection and exits."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import ELIMINATED

COHORTS = ("late_arrival", "original", "bombshell", "finalist", "still_in")


@dataclass(frozen=True)
class SideEntry:
    """Entries strictly between two days lead to a side location first; its survivors enter on a fixed day."""

    after_day: int = 25
    before_day: int = 30
    main_entry_day: int = 31


def _first_number(text: Column) -> Column:
    """First digit run, null without one."""
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    return F.when(digits != "", digits)


def clean_roster(raw: DataFrame, side: SideEntry = SideEntry(), glued_above: int = 200) -> DataFrame:
    """Raw roster texts to typed stints.

    An entry day above `glued_above` is a day with a footnote digit glued to it; its first two
    digits count.
    """
    entry = _first_number(F.col("Entered")).try_cast("int")
    entry = F.when(entry > glued_above, F.substring(entry.cast("string"), 1, 2).cast("int")).otherwise(entry)
    stints = raw.where("Islander IS NOT NULL").select(
        F.col("Islander").alias("entity"),
        F.col("Age").try_cast("int").alias("age"),
        F.col("Hometown").alias("hometown"),
        entry.alias("entry_day"),
        _first_number(F.col("Status")).try_cast("int").alias("leave_day"),
        F.split("Status", " ")[0].alias("first_word"),
    )
    in_band = (F.col("entry_day") > side.after_day) & (F.col("entry_day") < side.before_day)
    main_entry = F.when(
        in_band, F.when(F.col("leave_day").isNull(), F.lit(side.main_entry_day))
    ).otherwise(F.col("entry_day"))
    return stints.select(
        "entity",
        "age",
        "hometown",
        "entry_day",
        "leave_day",
        F.when(F.col("leave_day").isNotNull(), F.col("first_word")).alias("leave_status"),
        main_entry.alias("main_entry_day"),
    )


def load_and_clean(raw: DataFrame, cleaner: Callable[[DataFrame], DataFrame] = clean_roster) -> DataFrame:
    """Clean a roster with a pluggable cleaning function."""
    return raw.transform(cleaner)


def with_cohorts(roster: DataFrame) -> DataFrame:
    """Cohort flags per stint. A missing value on either side counts as "different"."""
    same_entry = F.coalesce(F.col("entry_day") == F.col("main_entry_day"), F.lit(False))
    original = F.coalesce(F.col("entry_day") == 1, F.lit(False))
    eliminated = F.coalesce(F.col("leave_status") == ELIMINATED, F.lit(False))
    return roster.withColumns(
        {
            "late_arrival": ~same_entry,
            "original": original,
            "bombshell": ~original,
            "finalist": ~eliminated,
            "still_in": F.col("leave_day").isNull(),
        }
    )


def pick_entities(roster: DataFrame, cohorts: Iterable[str] = ("finalist",)) -> DataFrame:
    """Distinct entities with a stint in any of the cohorts; the finalists by default."""
    wanted = list(cohorts)
    unknown = set(wanted) - set(COHORTS)
    if unknown:
        raise ValueError(f"unknown cohorts: {sorted(unknown)}")
    member = F.lit(False)
    for cohort in wanted:
        member = member | F.col(cohort)
    return with_cohorts(roster).where(member).select("entity").distinct()


def all_entities(roster: DataFrame) -> DataFrame:
    return roster.select("entity").distinct()


def keep_entities(frame: DataFrame, picked: DataFrame, column: str = "entity") -> DataFrame:
    """Rows whose entity is picked."""
    return frame.join(picked.select(F.col("entity").alias(column)), column, "left_semi")


def last_exits(roster: DataFrame) -> DataFrame:
    """One exit day per entity: that of its last stint, none while a stint is open.

    A plain aggregate, so no entity's stints have to meet in one task before they are folded.
    """
    return (
        roster.groupBy("entity")
        .agg(F.max("leave_day").alias("leave_day"), F.bool_or(F.col("leave_day").isNull()).alias("open"))
        .where(~F.col("open") & F.col("leave_day").isNotNull())
        .select("entity", "leave_day")
    )
