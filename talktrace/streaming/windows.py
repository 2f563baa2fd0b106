"""Sliding mention counts of a stream of messages, with late messages kept apart.

Two queries in turn. The intake decides once and for all which messages are late: older than the newest of
all earlier batches by more than the allowed delay. It writes the mentions of the others, and the late messages
themselves, by batch. The count is a watermarked window aggregation over the mentions: its state holds open
windows only, and it drops nothing, because its watermark never runs ahead of the intake's.

Everything is stored under one folder, by batch. A batch that is repeated after a failure replaces its own rows; the
count starts only after an intake has ended, and so never sees a batch that may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aliases import AliasBook
from ..operators.mentions import mention_rows, scan_mentions

HOUR = 3_600
_MENTIONS = "message_id bigint, created_epoch bigint, entity string, n bigint, batch bigint"
_PROGRESS = "latest bigint, batch bigint"
_COUNTS = "start bigint, entity string, messages bigint, n bigint, batch bigint"


class MentionStream:
    """The tables of one replayable stream: `mentions`, `late`, `progress` and `counts`, each by batch.

    `delay`, `size` and `slide` are seconds.
    """

    def __init__(
        self, spark: SparkSession, folder: str, aliases: DataFrame | AliasBook, delay: int = 6 * HOUR, size: int = 24 * HOUR, slide: int = 6 * HOUR
    ):
        self.spark, self.folder, self.aliases = spark, folder, aliases
        self.delay, self.size, self.slide = delay, size, slide

    def _path(self, table: str, batch: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch is None else f"/batch={batch}")

    def _read(self, table: str, schema: str) -> DataFrame:
        """A table's rows; none before its first batch."""
        self._empty(table, schema).write.mode("ignore").parquet(self._path(table))
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _empty(self, table: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema).drop("batch")

    def watermark_before(self, batch: int) -> int | None:
        """Messages of this batch that are older are late; nothing is late in a first batch."""
        latest = self._read("progress", _PROGRESS).where(F.col("batch") < batch).agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.delay

    def take_in(self, messages: DataFrame, batch: int) -> None:
        """Split one batch (message_id, created_epoch, body); a null time counts as late."""
        mark = self.watermark_before(batch)
        late = F.col("created_epoch").isNull()
        if mark is not None:
            late = late | (F.col("created_epoch") < mark)
        messages = messages.select("message_id", "created_epoch", "body").persist()
        try:
            messages.where(late).write.mode("overwrite").parquet(self._path("late", batch))
            scanned = scan_mentions(messages.where(~late), self.aliases, carry=("created_epoch",))
            rows = mention_rows(scanned).select("message_id", "created_epoch", "entity", "n")
            rows.write.mode("overwrite").parquet(self._path("mentions", batch))
            newest = messages.where(~late).agg(F.max("created_epoch").alias("latest"))
            newest.coalesce(1).write.mode("overwrite").parquet(self._path("progress", batch))
        finally:
            messages.unpersist()

    def _count(self) -> StreamingQuery:
        """Advance the window counts by the mentions that have come in."""
        self._read("mentions", _MENTIONS)
        rows = self.spark.readStream.schema(_MENTIONS).parquet(self._path("mentions"))
        timed = rows.withColumn("time", F.timestamp_seconds("created_epoch")).withWatermark("time", f"{self.delay} seconds")
        window = F.window("time", f"{self.size} seconds", f"{self.slide} seconds")
        counted = timed.groupBy(window, "entity").agg(F.count("*").alias("messages"), F.sum("n").alias("n"))
        shown = counted.select(F.unix_timestamp("window.start").alias("start"), "entity", "messages", "n")

        def store(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(self._path("counts", batch))

        return (
            shown.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", f"{self.folder}/_count").trigger(availableNow=True).start()
        )

    def pull(self, source: Callable[[], DataFrame]) -> StreamingQuery:
        """Take in all that is new in a stream of messages, then count it. Returns the count's query, ended."""
        intake = (
            source().writeStream.foreachBatch(self.take_in)
            .option("checkpointLocation", f"{self.folder}/_intake").trigger(availableNow=True).start()
        )
        intake.awaitTermination()
        count = self._count()
        count.awaitTermination()
        return count

    def counts(self, before: int | None = None) -> DataFrame:
        """start (of the window, epoch seconds), entity, messages, n: the last stored state of each window.

        `before` keeps windows that have ended by then.
        """
        stored = self._read("counts", _COUNTS)
        if before is not None:
            stored = stored.where(F.col("start") + self.size <= before)
        newest = F.max_by(F.struct("messages", "n"), "batch").alias("last")
        return stored.groupBy("start", "entity").agg(newest).select("start", "entity", "last.*")

    def late(self) -> DataFrame:
        """message_id, created_epoch, body and batch of the messages that came too late."""
        return self._read("late", "message_id bigint, created_epoch bigint, body string, batch bigint")


def sliding_mentions(rows: DataFrame, size: int = 24 * HOUR, slide: int = 6 * HOUR) -> DataFrame:
    """start, entity, messages, n of every sliding window that has a mention, from rows (created_epoch, entity, n).

    Rows are folded to one per entity and slide first; only these are dealt to the windows they lie in.
    """
    if size % slide:
        raise ValueError("the size must be a multiple of the slide")
    place = F.floor(F.col("created_epoch") / slide).cast("bigint") * slide
    folded = rows.groupBy(place.alias("at"), "entity").agg(F.count("*").alias("messages"), F.sum("n").alias("n"))
    starts = F.sequence(F.col("at") - (size - slide), F.col("at"), F.lit(slide).cast("bigint"))
    dealt = folded.select(F.explode(starts).alias("start"), "entity", "messages", "n")
    return dealt.groupBy("start", "entity").agg(F.sum("messages").alias("messages"), F.sum("n").alias("n"))
