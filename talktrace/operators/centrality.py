"""Weighted eigenvector centrality by power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir


class NoConvergence(RuntimeError):
    """The iteration cap was reached before the tolerance."""


def eigenvector_centrality(
    totals: DataFrame,
    entities: DataFrame | None = None,
    tolerance: float = 1e-6,
    max_iterations: int = 100,
    stride: int = 10,
) -> DataFrame:
    """(entity, centrality) of the undirected weighted graph; entities without an edge get 0.

    Iterates v <- (A + I) v; the identity makes it converge on bipartite graphs too. Weights are
    scaled by the largest, which leaves the eigenvector as it is. A stride of steps is one job:
    join on the source node, sum per target, folded before the shuffle. After it the vector is
    written to the checkpoint folder, which cuts the lineage, and only scalars (norms and the change
    of the last step) reach the driver. The join is left to Spark, which broadcasts the vector while it
    is small; a node has no more edges than there are entities.
    """
    ensure_checkpoint_dir(totals.sparkSession)
    # Each node gets an edge to itself in the same pass, so the graph is computed and stored once.
    edge = F.struct("x", "y", F.col("weight").cast("double").alias("w"))
    loop = F.struct("x", F.col("x").alias("y"), F.lit(0.0).alias("w"))
    stored = (
        totals.where("weight > 0")
        .select(F.inline(F.array(edge, loop)))
        .groupBy("x", "y")
        .agg(F.max("w").alias("w"))
        .checkpoint()
    )
    nodes = stored.where("x = y").select(F.col("x").alias("entity"))
    peak, = stored.agg(F.max("w")).first()
    if peak is None:
        return _with_isolated(nodes.withColumn("centrality", F.lit(0.0)), entities)
    weight = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(F.col("w") / peak)
    links = stored.select("x", "y", weight.alias("w"))
    vector, done = nodes.withColumn("v", F.lit(1.0)), 0
    while True:
        steps = min(stride, max_iterations - done)
        if not steps:
            raise NoConvergence(f"no convergence within {max_iterations} iterations")
        for _ in range(steps):
            reached = links.join(vector, links["y"] == vector["entity"])
            vector = reached.groupBy(F.col("x").alias("entity")).agg(
                F.sum(F.col("w") * F.col("v")).alias("v"),
                # A node's edge to itself brings along its value of the step before.
                F.max(F.when(F.col("x") == F.col("y"), F.col("v"))).alias("before"),
            )
        done += steps
        vector = vector.checkpoint()
        size, norm, norm_before = vector.agg(
            F.count("*"), *[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("v", "before")]
        ).first()
        change, = vector.agg(F.sum(F.abs(F.col("v") / norm - F.col("before") / norm_before))).first()
        vector = vector.select("entity", (F.col("v") / norm).alias("v"))
        if change < size * tolerance:
            break
    return _with_isolated(vector.withColumnRenamed("v", "centrality"), entities)


def _with_isolated(vector: DataFrame, entities: DataFrame | None) -> DataFrame:
    if entities is None:
        return vector
    known = entities.select("entity").distinct().join(vector, "entity", "left")
    return known.select("entity", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def most_central(centrality: DataFrame, picked: DataFrame) -> DataFrame:
    """The most central picked entity, ties by name."""
    chosen = centrality.join(picked.select("entity"), "entity", "left_semi")
    return chosen.orderBy(F.desc("centrality"), "entity").limit(1)
