"""The search index: postings as a table, partitioned by day, in order of their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import within_days
from ..operators.search import postings, search, terms
from ..session import written
from .store import _only_touched_partitions

# The partition of messages without a day.
NO_DAY = -(1 << 30)


class SearchIndex:
    """Postings of messages. An update rewrites the days that it touches; a search reads its terms and days.

    Within a file postings are in order of term, so that row groups are skipped by their statistics.
    """

    def __init__(self, spark: SparkSession, database: str = "search"):
        self.spark = spark
        self.table = f"{database}.postings"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} "
            "(term string, message_id bigint, tf bigint, length bigint, lead boolean, day int) USING parquet PARTITIONED BY (day)"
        )

    def postings(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """All postings, or those of a range of days."""
        if first is None and last is not None:
            first = NO_DAY + 1
        return within_days(self.spark.table(self.table), first, last)

    def update(self, messages: DataFrame) -> None:
        """Index new and changed messages (message_id, day, body), unique by id; others stay as they are.

        A message that was indexed before, on whatever day, is replaced; one that has lost its words leaves the index. Messages
        without a day are kept under NO_DAY, outside of every range.
        """
        messages = messages.withColumn("day", F.coalesce("day", F.lit(NO_DAY)))
        ids = messages.select("message_id")
        held = self.postings().where("lead").select("message_id", "day").join(ids, "message_id", "left_semi")
        days = {r[0] for r in held.select("day").union(messages.select("day")).distinct().collect()}  # the calendar's
        if not days:
            return
        kept = self.postings().where(F.col("day").isin(sorted(days))).join(ids, "message_id", "left_anti")
        columns = ("term", "message_id", "tf", "length", "lead", "day")
        fresh = written(postings(messages).select(*columns))
        filled = {r[0] for r in kept.select("day").union(fresh.select("day")).distinct().collect()}
        ordered = kept.select(*columns).unionByName(fresh).hint("rebalance", "day").sortWithinPartitions("day", "term")
        with _only_touched_partitions(self.spark):
            ordered.write.mode("overwrite").insertInto(self.table)
        for day in sorted(days - filled):  # days that have lost their last posting are not written above
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (day = {day})")

    def search(self, queries: DataFrame, k: int = 10, first: int | None = None, last: int | None = None) -> DataFrame:
        """query_id, rank, message_id, score for each of `queries` (query_id, query), over a range of days."""
        return search(self.postings(first, last), queries, k)

    def find(self, query: str, k: int = 10, first: int | None = None, last: int | None = None) -> DataFrame:
        """rank, message_id, score for one query; its terms reach the scan."""
        asked = self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))
        words = asked.select(terms("query")).first()[0]
        found = self.postings(first, last).where(F.col("term").isin(words) | F.col("lead"))
        return search(found, asked, k).drop("query_id")
