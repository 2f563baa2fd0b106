"""Hop distances and components of the graph; every round starts from tables in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written


def hop_distances(edges: DataFrame, sources: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(entity, hops) for every one of `nodes` (entity): the fewest edges (x, y) from any of `sources` (entity) to it, null
    where there is no way, or none of at most `most` edges.

    Levels are searched one after the other. A level joins the frontier with the edges and keeps what no level
    has reached yet; it is written to the checkpoint folder, so that a lost executor repeats one level. The
    driver sees only whether a level is empty. Edges are followed from x to y; both directions are two rows.
    """
    links = written(edges.where("x <> y").select("x", "y").distinct())
    frontier = written(sources.where("entity IS NOT NULL").select("entity").distinct().withColumn("hops", F.lit(0)))
    reached, hops = frontier, 0
    while not frontier.isEmpty() and (most is None or hops < most):
        hops += 1
        ahead = frontier.join(links, F.col("entity") == F.col("x")).select(F.col("y").alias("entity")).distinct()
        frontier = written(ahead.join(reached.select("entity"), "entity", "left_anti").withColumn("hops", F.lit(hops)))
        reached = reached.unionByName(frontier)
    return nodes.select("entity").distinct().join(reached, "entity", "left")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of `edges` (x, y); a component is named by its least node.

    Every node points to the least of itself and its neighbours; pointers are followed to their ends, and the graph is
    contracted to these, until no edge joins two of them. Minima are folded before the shuffle.
    """
    ends = edges.where("x IS NOT NULL AND y IS NOT NULL").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    left = written(ends.distinct())
    labels = left.select(F.col("x").alias("node")).union(left.select("y")).distinct().withColumn("component", F.col("node"))
    left = left.where("x <> y")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        point = written(both.groupBy(F.col("x").alias("component")).agg(F.least("component", F.min("y")).alias("least")))
        moved = True
        while moved:  # two steps in one job, each of which doubles how far a pointer reaches
            further = written(_followed(_followed(point)))
            moved = not further.join(point, ["component", "least"], "left_anti").isEmpty()
            point = further
        labels = _relabelled(labels, point)
        at = {side: point.select(F.col("component").alias(side), F.col("least").alias(f"{side}_end")) for side in "xy"}
        ends = left.join(at["x"], "x").join(at["y"], "y").where("x_end <> y_end")
        left = written(ends.select(F.least("x_end", "y_end").alias("x"), F.greatest("x_end", "y_end").alias("y")).distinct())
    return labels


def _followed(point: DataFrame) -> DataFrame:
    """Pointers (component, least) to where their targets point."""
    ahead = point.select(F.col("component").alias("least"), F.col("least").alias("next"))
    return point.join(ahead, "least").select("component", F.col("next").alias("least"))


def _relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after components have become others: `step` has component, least."""
    moved = labels.join(step, "component", "left")
    return written(moved.select("node", F.coalesce("least", "component").alias("component")))


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after more edges: (node, component), from those so far and the new edges (x, y) alone.

    The ends of new edges become the components they are in, or themselves where they are new; only these, as
    many as there are new edges, are joined up. The labels so far are read once and never recomputed.
    """
    known = labels.select("node", "component")
    named = edges.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    for side in "xy":
        at = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        named = named.join(at, side, "left")
    named = written(named)
    fresh = named.where("x_in IS NULL").select(F.col("x").alias("node")).union(named.where("y_in IS NULL").select("y")).distinct()
    joined = components(named.select(F.coalesce("x_in", "x").alias("x"), F.coalesce("y_in", "y").alias("y")))
    step = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return _relabelled(known.unionByName(fresh.withColumn("component", F.col("node"))), step)


def components_by_day(edges: DataFrame, first: int, last: int) -> DataFrame:
    """(day, node, component): the components of all edges (day, x, y) up to each day of the range.

    One step per day, of the size of the day's edges; each day's labels stay as they were stored.
    """
    labels, found = None, None
    for day in range(first, last + 1):
        new = edges.where(F.col("day") == day) if labels is not None else edges.where(F.col("day") <= day)
        labels = components(new) if labels is None else extend_components(labels, new)
        marked = labels.select(F.lit(day).alias("day"), "node", "component")
        found = marked if found is None else found.unionByName(marked)
    return found
