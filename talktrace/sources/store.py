"""The archive's tables and the materialised analytics, as parquet tables of a catalog database."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import after_and_before
from ..schemas import ALL_TABLES, CORRUPT, MESSAGES, THREADS, TableSpec
from ..session import written
from .quality import CheckedRows, check_rows

BUCKET, DAY, DAY_SECONDS, NO_DAY = "bucket", "created_day", 86_400, -(1 << 40)
REJECTED = "Rejected"
# Bytes per key besides its text, and the size up to which keys are broadcast.
KEY_OVERHEAD, MAX_BROADCAST_BYTES = 64, 128 * 1024 * 1024
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def latest_rows(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last loaded row of each key; of rows with the same sequence the greatest by creation time, then values.

    Written as an aggregate rather than a ranking, so that a key loaded without end is folded
    where it is read instead of being sorted in one task.
    """
    first = [F.col(c) for c in (sequence, "createdDate") if c in rows.columns]
    values = F.struct(*[F.col(c) for c in rows.columns])
    places = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(first)], values.alias("row"))
    return rows.groupBy(key).agg(F.max(places).alias("last")).select("last.row.*")


def _latest_of_repeated(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """`latest_rows`, for keys that seldom repeat: keys are counted first, and only rows of repeated ones are shuffled."""
    repeated = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if repeated.isEmpty():
        return rows
    shared = latest_rows(rows.join(repeated, key, "left_semi"), key, sequence)
    return rows.join(repeated, key, "left_anti").unionByName(shared)


def upsert_latest(
    base: DataFrame, delta: DataFrame, key: str, sequence: str, few_keys: bool = False
) -> DataFrame:
    """Base rows whose key is not in the delta, and the last delta row of each key.

    The base, unique by key, is only filtered; no aggregate runs over it. With `few_keys`, which
    says that the delta's keys have been measured and are small, it is not shuffled either.
    """
    changed = latest_rows(delta, key, sequence)
    keys = changed.select(key)
    return base.join(F.broadcast(keys) if few_keys else keys, key, "left_anti").unionByName(changed)


def high_water_mark(rows: DataFrame, column: str) -> DataFrame:
    """The latest insertion time."""
    return rows.agg(F.max(column).alias("latest"))


def messages_of(messages: DataFrame, threads: DataFrame, thread_id: str = "thread_id") -> DataFrame:
    """Messages of a set of threads; the set may be of any size."""
    return messages.join(threads.select(thread_id), thread_id, "left_semi")


@contextmanager
def _only_touched_partitions(spark: SparkSession) -> Iterator[None]:
    """Overwrite the partitions that are written and no others. The new files are staged until the
    job has succeeded, so a table can be read and rewritten in one go."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


class ArchiveStore:
    """The four tables. Those with a creation time are partitioned by its day, the others by a hash of their key.

    A pull of recent threads then rewrites the partitions of few days, and a date range reads no others.
    A key whose creation time has changed is found by its key column alone, and its old partition is
    rewritten, too. Rows lie in creation order within a file, so that row groups are skipped by statistics.
    """

    def __init__(self, spark: SparkSession, database: str = "archive", buckets: int = 64):
        self.spark = spark
        self.database = database
        self.buckets = buckets

    def _name(self, table: TableSpec) -> str:
        return f"{self.database}.{table.name}"

    def _partition(self, table: TableSpec) -> tuple[str, Column]:
        """The partition column and its value for a row."""
        if "createdDate" in table.column_names:
            return DAY, F.coalesce(F.expr(f"createdDate div {DAY_SECONDS}"), F.lit(NO_DAY))
        return BUCKET, F.pmod(F.xxhash64(table.key), F.lit(self.buckets))

    def create(self, table: TableSpec) -> None:
        column, _ = self._partition(table)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({table.ddl}, {column} bigint) "
            f"USING parquet PARTITIONED BY ({column})"
        )

    def create_all(self) -> None:
        for table in ALL_TABLES:
            self.create(table)

    def drop(self, table: TableSpec) -> None:
        self.spark.sql(f"DROP TABLE {self._name(table)}")

    def drop_all(self) -> None:
        for table in ALL_TABLES:
            self.drop(table)

    def scan(self, table: TableSpec) -> DataFrame:
        """All rows, with the columns in table order."""
        return self.spark.table(self._name(table)).select(*table.column_names)

    def replace_into(self, table: TableSpec, rows: DataFrame, sequence: str = "insertionTimestamp") -> CheckedRows:
        """Insert or replace rows by key; rows that cannot be stored are returned, not lost."""
        wanted = [*table.column_names, *(c for c in rows.columns if c == CORRUPT)]
        checked = check_rows(rows.select(*wanted), table)
        column, value = self._partition(table)
        delta = checked.accepted.withColumn(column, value)
        stored = self.spark.table(self._name(table))
        # A row per partition of the delta. As literals they prune those of the base; the size of the
        # keys decides whether they can be sent to the base or the base has to be shuffled.
        key_size = F.sum(F.octet_length(table.key) + KEY_OVERHEAD)
        sizes = {r[0]: r[1] for r in delta.groupBy(column).agg(key_size).collect()}
        if not sizes:
            return checked
        few_keys = sum(sizes.values()) <= MAX_BROADCAST_BYTES
        touched = set(sizes)
        if column == DAY:  # where the keys are now, one row per day
            keys = delta.select(table.key)
            held = stored.select(table.key, column).join(F.broadcast(keys) if few_keys else keys, table.key, "left_semi")
            touched |= {r[0] for r in held.select(column).distinct().collect()}
        base = stored.where(F.col(column).isin(sorted(touched)))
        changed = _latest_of_repeated(delta, table.key, sequence)
        if few_keys:
            kept = base.join(F.broadcast(delta.select(table.key)), table.key, "left_anti")
        else:  # keys alone are shuffled; of days that are pulled anew few rows stay
            staying = base.select(table.key).join(delta.select(table.key), table.key, "left_anti")
            kept = base.join(written(staying), table.key, "left_semi")
        merged = kept.unionByName(changed).select(*table.column_names, column)
        order = ["createdDate"] if column == DAY else [table.key]
        # Rebalancing splits a partition that is too large for one file and joins those that are small.
        ordered = merged.hint("rebalance", column).sortWithinPartitions(column, *order)
        emptied = touched - set(sizes)
        with _only_touched_partitions(ordered.sparkSession):
            ordered.write.mode("overwrite").insertInto(self._name(table))
        self._drop_moved(table, column, emptied, delta)
        return checked

    def _drop_moved(self, table: TableSpec, column: str, emptied: set, delta: DataFrame) -> None:
        """Partitions that hold nothing but rows that have moved are not written above, and go here."""
        for value in sorted(emptied):
            left = self.spark.table(self._name(table)).where(F.col(column) == value)
            if left.join(delta.select(table.key), table.key, "left_anti").isEmpty():
                self.spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS PARTITION ({column} = {value})")

    def create_rejected(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.database}.{REJECTED} "
            "(table_name string, reason string, record string, batch bigint) USING parquet PARTITIONED BY (batch)"
        )

    def keep_rejected(self, rejected: list[tuple[str, DataFrame]], batch: int) -> None:
        """Store what a batch could not, as (table, reason, record). A repeated batch replaces its own rows."""
        self.create_rejected()
        kept = None
        for name, rows in rejected:
            if "record" not in rows.columns:
                rows = rows.withColumn("record", F.to_json(F.struct(*[c for c in rows.columns if c != "reason"])))
            rows = rows.select(F.lit(name).alias("table_name"), "reason", "record", F.lit(batch).cast("bigint").alias("batch"))
            kept = rows if kept is None else kept.unionByName(rows)
        with _only_touched_partitions(kept.sparkSession):
            kept.write.mode("overwrite").insertInto(f"{self.database}.{REJECTED}")

    def rejected(self) -> DataFrame:
        self.create_rejected()
        return self.spark.table(f"{self.database}.{REJECTED}")

    def thread_ids(self) -> DataFrame:
        return self.scan(THREADS).select(THREADS.key)

    def last_insertion(self) -> int | None:
        return high_water_mark(self.scan(THREADS), "insertionTimestamp").first()[0]

    def created_between(self, table: TableSpec, after_epoch: int, before_epoch: int | None = None) -> DataFrame:
        """Rows created strictly after, and strictly before if given; other days' partitions are not read."""
        days = F.col(DAY) >= after_epoch // DAY_SECONDS
        if before_epoch is not None:
            days = days & (F.col(DAY) <= before_epoch // DAY_SECONDS)
        before = None if before_epoch is None else F.lit(before_epoch)
        stored = self.spark.table(self._name(table)).where(days)
        return after_and_before(stored, "createdDate", F.lit(after_epoch), before).select(*table.column_names)

    def messages_for_threads(self, threads: DataFrame) -> DataFrame:
        """Messages whose PostID is in the given rows."""
        return messages_of(self.scan(MESSAGES), threads, THREADS.key)


class Materialised:
    """Derived tables that are computed once, partitioned by day, and reloaded afterwards.

    A name is a view of its newest version. The `previous` versions before it stay, so that plans which others
    built on one of them still run after a recomputation.
    """

    def __init__(self, spark: SparkSession, database: str = "analytics", previous: int = 1):
        self.spark = spark
        self.database = database
        self.previous = previous
        self._held: dict[str, DataFrame] = {}

    def versions(self, name: str) -> list[str]:
        """The stored versions of a table, oldest first: names carry their time."""
        return sorted(t.name for t in self.spark.catalog.listTables(self.database, f"{name}__*"))

    def replace(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Compute and store, whether or not it exists."""
        self.release(name)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        table, fresh = f"{self.database}.{name}", f"{name}__{time.time_ns():020d}_{uuid.uuid4().hex}"
        # A busy day is split over several files instead of being written by one task.
        build().hint("rebalance", "day").write.partitionBy("day").saveAsTable(f"{self.database}.{fresh}")
        # The name is a view that is switched once the new version is complete; then old ones go.
        self.spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {self.database}.{fresh}")
        older = [v for v in self.versions(name) if v.lower() != fresh.lower()]
        for version in older[: len(older) - self.previous]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{version}")
        return self.spark.table(table)

    def load(
        self, name: str, build: Callable[[], DataFrame], force: bool = False, hold: bool = False
    ) -> DataFrame:
        """The stored table, computed first if it is missing or `force` is set; `hold` keeps it in memory."""
        if hold and not force and name in self._held:
            return self._held[name]
        table = f"{self.database}.{name}"
        if force or not self.spark.catalog.tableExists(table):
            frame = self.replace(name, build)
        else:
            frame = self.spark.table(table)
        if hold:
            self._held[name] = frame.persist()
        return frame

    def release(self, name: str) -> None:
        held = self._held.pop(name, None)
        if held is not None:
            held.unpersist()
