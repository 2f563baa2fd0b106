"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "talktrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at storage that the session names.

    That is `spark.checkpoint.dir`, which a cluster sets to a shared folder; where it is unset, a folder
    in the session's warehouse.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, for stored steps; all executors share it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the checkpoint folder. Loops start their next plan from its files alone, of known size,
    and carry over nothing of what the optimizer has inferred about earlier rounds."""
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def local_table(spark: SparkSession, rows: Iterable[tuple], **columns: pa.DataType) -> DataFrame:
    """A small table of given rows.

    Spark knows the size of a table made from Arrow data, unlike that of one made from Python
    rows, and so can broadcast it instead of shuffling the large side of a join by its key.
    """
    records = [dict(zip(columns, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=pa.schema(list(columns.items()))))


def selection(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Entities picked by name."""
    return local_table(spark, [(n,) for n in sorted(set(names))], entity=pa.string())
