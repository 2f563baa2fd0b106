"""Who is mentioned together with whom.

Input is `mention_sets`: one row per message with its name-sorted `found` array. Edges are stored in
both directions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import within_days
from ..session import selection
from .roster import keep_entities


def _team(sets: DataFrame, exclude: str | None) -> Column:
    names = F.col("found.entity")
    return names if exclude is None else F.filter(names, lambda e: e != exclude)


def _if_any(pairs: Column) -> Column:
    """Pairs as input of a generator, in a form that Spark does not evaluate once more as a filter."""
    return F.when(F.size("team") > 1, pairs)


def comention_pairs(sets: DataFrame, exclude: str | None = None) -> DataFrame:
    """Each ordered pair of the entities of a message once, however often they are mentioned."""
    teams = sets.select("message_id", "day", _team(sets, exclude).alias("team"))
    ones = teams.select("*", F.explode(_if_any(F.col("team"))).alias("x"))
    others = F.filter("team", lambda y: y != F.col("x"))
    return ones.select("message_id", "day", "x", F.explode(others).alias("y"))


def edges_daily(sets: DataFrame, exclude: str | None = None) -> DataFrame:
    """Messages per day that mention both x and y.

    Messages that mention the same entities on the same day are counted first, and pairs are formed
    once per such group instead of once per message, in one direction; the other is added at the end.
    """
    teams = sets.select("day", _team(sets, exclude).alias("team")).where(F.size("team") > 1)
    counted = teams.groupBy("day", "team").agg(F.count("*").alias("k"))
    pairs = F.flatten(
        F.transform(
            "team",
            lambda x, i: F.transform(
                F.slice("team", i + 2, F.size("team")), lambda y: F.struct(x.alias("x"), y.alias("y"))
            ),
        )
    )
    one_way = (
        counted.select("day", "k", F.inline(_if_any(pairs))).groupBy("day", "x", "y").agg(F.sum("k").alias("weight"))
    )
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return one_way.select("day", "weight", F.inline(both)).select("day", "x", "y", "weight")


def edges_total(edges: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Edge weights summed over the day range."""
    return within_days(edges, first, last).groupBy("x", "y").agg(F.sum("weight").alias("weight"))


def dense_pairs(totals: DataFrame, entities: Sequence[str]) -> DataFrame:
    """All ordered pairs of the given entities with their weight, 0 if never mentioned together.

    The pairs themselves are what is asked for here; nothing else in the library uses this form.
    """
    names = sorted(set(entities))
    partners = F.array(*map(F.lit, names))
    pairs = (
        selection(totals.sparkSession, names)
        .select(F.col("entity").alias("x"), F.explode(partners).alias("y"))
        .where("x <> y")
    )
    return pairs.join(totals, ["x", "y"], "left").select(
        "x", "y", F.coalesce("weight", F.lit(0)).alias("weight")
    )


def picked_subgraph(totals: DataFrame, picked: DataFrame) -> DataFrame:
    """Positive edges with both ends picked, with their label. Without any there is nothing to show."""
    inside = keep_entities(keep_entities(totals.where("weight > 0"), picked, "x"), picked, "y")
    return inside.select("x", "y", "weight", F.concat("x", F.lit(" to "), "y").alias("label"))


def closest_neighbors(subgraph: DataFrame) -> DataFrame:
    """Per node its partner of greatest weight within the subgraph, ties by name."""
    best = F.min_by("y", F.struct(-F.col("weight"), F.col("y")))
    return subgraph.groupBy(F.col("x").alias("name")).agg(
        best.alias("closest_neighbor"), F.max("weight").alias("weight")
    )


def graph_nodes(subgraph: DataFrame, centrality: DataFrame) -> DataFrame:
    """Node attributes: centrality as a percentage text, and the closest neighbour."""
    scores = centrality.withColumnRenamed("entity", "name")
    shown = F.format_string("%.2f%%", F.col("centrality") * 100)
    return closest_neighbors(subgraph).join(scores, "name").select(
        "name", shown.alias("centrality"), "closest_neighbor"
    )


def comention_matrix(totals: DataFrame) -> DataFrame:
    """All positive edges as (name, partner, weight)."""
    return totals.where("weight > 0").select(F.col("x").alias("name"), F.col("y").alias("partner"), "weight")


def partner_breakdown(totals: DataFrame, name: str | None = None) -> DataFrame:
    """Partners of a node, picked or not, with their share and rank by weight; of all nodes without a name."""
    matrix = comention_matrix(totals)
    if name is not None:
        matrix = matrix.where(F.col("name") == name)
    node = Window.partitionBy("name")
    return matrix.select(
        "name",
        "partner",
        "weight",
        (F.col("weight") / F.sum("weight").over(node)).alias("share"),
        F.row_number().over(node.orderBy(F.desc("weight"), "partner")).alias("rank"),
    )
