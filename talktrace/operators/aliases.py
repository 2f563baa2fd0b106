"""Alias dictionaries: building, ordering and inverting them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.labels import short_label
from ..session import local_table

# The largest dictionary that becomes part of a plan.
MOST_IN_PLAN = 50_000


def alias_dictionary(wide: DataFrame, entity: str, alias_columns: Sequence[str], row_order: str) -> DataFrame:
    """Wide rows (entity and its aliases) to (alias, entity, alias_order).

    Reading order is column by column, then row by row. A repeated alias keeps the place of its
    first appearance and the entity of its last. Both are plain aggregates, so an alias that
    repeats without end is folded before the shuffle.
    """
    cells = wide.select(
        F.col(entity).alias("entity"),
        F.col(row_order).alias("row_no"),
        F.posexplode(F.array(*[F.col(c) for c in alias_columns])).alias("column_no", "alias"),
    ).where("alias IS NOT NULL AND entity IS NOT NULL")
    place = F.struct("column_no", "row_no")
    return cells.groupBy("alias").agg(
        F.max_by("entity", place).alias("entity"), F.min(place).alias("alias_order")
    )


def search_dictionary(names: DataFrame, entity: str, row_order: str, aliases: DataFrame | None = None) -> DataFrame:
    """First token of each full name to the name (the last duplicate wins); aliases override names."""
    entries = names.select(
        short_label(F.col(entity)).alias("alias"),
        F.col(entity).alias("entity"),
        F.lit(0).alias("source"),
        F.col(row_order).cast("bigint").alias("place"),
    )
    if aliases is not None:
        entries = entries.unionByName(
            aliases.select("alias", "entity", F.lit(1).alias("source"), F.lit(0).cast("bigint").alias("place"))
        )
    return entries.groupBy("alias").agg(F.max_by("entity", F.struct("source", "place")).alias("entity"))


def alias_lists(aliases: DataFrame) -> DataFrame:
    """Entity to its aliases in dictionary order; a list holds one entity's aliases, each once."""
    ordered = F.sort_array(F.collect_list(F.struct("alias_order", "alias")))
    return aliases.groupBy("entity").agg(F.transform(ordered, lambda e: e["alias"]).alias("aliases"))


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, entity), each non-empty alias once: of a repeated one the entity that is last in order."""
    named = aliases.where("alias IS NOT NULL AND alias <> '' AND entity IS NOT NULL")
    place = F.struct("alias_order", "entity") if "alias_order" in aliases.columns else F.col("entity")
    return named.groupBy("alias").agg(F.max_by("entity", place).alias("entity"))


@dataclass(frozen=True)
class AliasBook:
    """A dictionary as part of a plan, ordered by entity, then alias order."""

    entries: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        names = [alias for alias, _ in self.entries]
        if not all(names) or len(set(names)) < len(names):
            raise ValueError("aliases must be non-empty and unique")

    @classmethod
    def of(cls, aliases: DataFrame | AliasBook) -> AliasBook:
        """The driver gets the dictionary, of at most MOST_IN_PLAN aliases; a larger one is refused, never cut.

        `scan_mentions` says when it is needed: whole words are matched with dictionaries of any size.
        """
        if isinstance(aliases, AliasBook):
            return aliases
        order = aliases.groupBy("alias").agg(F.min("alias_order").alias("alias_order"))
        wanted = unique_aliases(aliases).join(order, "alias").select("entity", "alias_order", "alias")
        rows = wanted.limit(MOST_IN_PLAN + 1).collect()
        if len(rows) > MOST_IN_PLAN:
            raise ValueError(f"more than {MOST_IN_PLAN} aliases cannot be part of a plan; match them as whole words")
        return cls(tuple((r["alias"], r["entity"]) for r in sorted(rows)))

    def __len__(self) -> int:
        return len(self.entries)

    @property
    def entities(self) -> list[str]:
        return sorted({entity for _, entity in self.entries})

    def pattern(self, boundary: str) -> str:
        if not self.entries:
            return text.NOTHING
        if boundary == "word":
            return text.whole_word_pattern([alias for alias, _ in self.entries])
        if boundary == "outer":
            groups = groupby(self.entries, key=lambda e: e[1])
            return text.outer_edge_pattern([[alias for alias, _ in g] for _, g in groups])
        raise ValueError(f"boundary must be 'word' or 'outer', not {boundary!r}")

    def lookup(self) -> Column:
        """A literal map from alias to entity."""
        if not self.entries:
            return F.create_map(F.lit(""), F.lit(None).cast("string"))
        return F.create_map(*[F.lit(v) for entry in self.entries for v in entry])

    def table(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.entries, alias=pa.string(), entity=pa.string())
