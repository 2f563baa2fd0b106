"""Helpers shared by the corpus operators: table access, stored steps, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder

# Rows that are sent to a Python worker at once where whole texts are; workers and executors hold a batch each.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made inside send at most BATCH_ROWS rows at once to Python workers, which keeps what they and the executors hold small."""
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a step that is stored inside go as soon as it is stored, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def stored_at(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame, computed once and written as a table to the folder that all executors share; and the table's path.

    Later plans start from its files, so lost executors cost no recomputation of what came before.
    """
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def stored(frame: DataFrame) -> DataFrame:
    return stored_at(frame)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no plan will read again; one that is gone already is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_salt(salts: int, *columns: str) -> Column:
    """A number below `salts` that depends on the row only."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their ends, and
    contracts the graph to those ends. Every step is a join or a minimum by key: minima are folded
    before the shuffle, and joins read stored tables, so adaptive execution can split a hot key.
    The driver sees only whether something is left.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
        while True:
            ahead = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(parents.join(ahead, "root").select("node", F.col("next").alias("root"),
                                                               (F.col("next") < F.col("root")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parents = jumped.drop("moved")
            if not moved:
                break
        ends = {side: parents.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")) for side in "ab"}
        step = parents.withColumnRenamed("node", "old").withColumnRenamed("root", "new")
        labels = parents if labels is None else stored(
            labels.join(step, F.col("root") == F.col("old"), "left")
            .select("node", F.coalesce("new", "root").alias("root"))
        )
        edges = stored(
            edges.join(ends["a"], "a").join(ends["b"], "b")
            .select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            .where("a <> b").distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
