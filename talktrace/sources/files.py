"""Delimited inputs, with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.calendar import day_index
from ..functions.labels import thread_type
from ..operators.aliases import alias_dictionary
from .quality import CheckedRows, split_unreadable


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> CheckedRows:
    """Header and doubled quotes; rows that do not fit the schema are kept aside with their text.

    With `multi_line`, line breaks may stand inside quotes; a file is then one task, so a large archive should
    come as many files.
    """
    reader = (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnPruning", False)  # or columns that a query leaves out would not be checked
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
    )
    return split_unreadable(reader.csv(path))


def write_csv(frame: DataFrame, path: str) -> None:
    """Delimited files for `read_csv`: header, doubled quotes, outer blanks kept.

    They come back unchanged, but for empty texts, which come back as null. Where texts hold line breaks they have to
    be read with `multi_line`.
    """
    writer = frame.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def with_day(messages: DataFrame, origin_epoch: int, epoch: str = "createdDate") -> DataFrame:
    """Add the UTC timestamp and the day index."""
    return messages.withColumns(
        {"date": F.timestamp_seconds(epoch), "day": day_index(F.col(epoch), origin_epoch)}
    )


def load_messages(spark: SparkSession, path: str, origin_epoch: int, multi_line: bool = True) -> DataFrame:
    """Readable messages in the engine's vocabulary; `read_csv` gives the others."""
    raw = with_day(read_csv(spark, path, schemas.MESSAGE_CSV, multi_line).accepted, origin_epoch)
    return raw.withColumnsRenamed(
        {
            "CommentID": "message_id",
            "PostID": "thread_id",
            "AuthorID": "author_id",
            "AuthorName": "author",
            "createdDate": "created_epoch",
            "parentID": "parent_id",
            "insertionTimestamp": "inserted_epoch",
        }
    )


def load_threads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Threads with their type."""
    return read_csv(spark, path, schemas.THREAD_CSV, multi_line).accepted.withColumn("type", thread_type(F.col("title")))


def load_roster(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned stints."""
    return read_csv(spark, path, schemas.ROSTER_CSV).accepted.withColumnsRenamed(
        {
            "Islander": "entity",
            "Age": "age",
            "Hometown": "hometown",
            "ShowEntryDay": "entry_day",
            "ShowLeaveDay": "leave_day",
            "OnLeaveStatus": "leave_status",
            "MainVillaEntryDay": "main_entry_day",
        }
    )


def load_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline events, one row per event and entity."""
    return read_csv(spark, path, schemas.TIMELINE_CSV).accepted.withColumnsRenamed(
        {"Day": "day", "Type": "type", "Summary": "summary", "Islanders": "entity"}
    )


def load_aliases(spark: SparkSession, path: str, alias_columns: int = 4) -> DataFrame:
    """The wide alias files to a dictionary. Row order is the order of the files' paths, then that in the file."""
    names = [f"alias_{i}" for i in range(1, alias_columns + 1)]
    schema = ", ".join(f"{c} string" for c in ("entity", *names))
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", True)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    wide = reader.csv(path).select("*", place.alias("row_no"))
    return alias_dictionary(wide, "entity", names, "row_no")


@dataclass(frozen=True)
class RawInputs:
    """Everything the analytics start from."""

    messages: DataFrame
    threads: DataFrame
    roster: DataFrame
    timeline: DataFrame
    aliases: DataFrame
    rejected: DataFrame


def rejected_rows(spark: SparkSession, messages: str, threads: str, roster: str, timeline: str) -> DataFrame:
    """table_name, reason and record of every row that the loaders leave out."""
    parts = [
        ("messages", messages, schemas.MESSAGE_CSV, True),
        ("threads", threads, schemas.THREAD_CSV, True),
        ("roster", roster, schemas.ROSTER_CSV, False),
        ("timeline", timeline, schemas.TIMELINE_CSV, False),
    ]
    kept = None
    for name, path, schema, multi_line in parts:
        rows = read_csv(spark, path, schema, multi_line).rejected.select(F.lit(name).alias("table_name"), "reason", "record")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


def load_raw(
    spark: SparkSession, messages: str, threads: str, roster: str, timeline: str, aliases: str, origin_epoch: int
) -> RawInputs:
    return RawInputs(
        load_messages(spark, messages, origin_epoch),
        load_threads(spark, threads),
        load_roster(spark, roster),
        load_timeline(spark, timeline),
        load_aliases(spark, aliases),
        rejected_rows(spark, messages, threads, roster, timeline),
    )


# The headings under which messages and threads are displayed (in the two functions below).


def message_table(messages: DataFrame) -> DataFrame:
    """Messages as displayed."""
    return messages.select(
        F.col("day").alias("Day"),
        F.timestamp_seconds("created_epoch").alias("Date"),
        F.col("body").alias("Text"),
        F.col("score").alias("Score"),
        F.col("compound").alias("Sentiment Score"),
        F.col("author").alias("Author's username"),
        F.col("permalink").alias("Permalink"),
        F.timestamp_seconds("inserted_epoch").alias("Date Inserted (to db)"),
    )


def thread_table(threads: DataFrame, origin_epoch: int) -> DataFrame:
    """Threads as displayed, with their day."""
    return threads.select(
        day_index(F.col("createdDate"), origin_epoch).alias("Day"),
        F.col("type").alias("Type of Discussion Thread"),
        F.timestamp_seconds("createdDate").alias("Date"),
        F.col("title").alias("Title"),
        F.col("selfText").alias("Text"),
        F.col("score").alias("Score"),
        F.col("AuthorName").alias("Author's username"),
        F.col("permalink").alias("Permalink"),
        F.timestamp_seconds("insertionTimestamp").alias("Date Inserted (to db)"),
    )


def season_length(messages: DataFrame, origin_epoch: int) -> DataFrame:
    """Day index of the latest message."""
    return messages.agg(day_index(F.max("created_epoch"), origin_epoch).alias("last_day"))
