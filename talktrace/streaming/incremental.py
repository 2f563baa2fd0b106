"""Pull what is new and upsert it: the batch ingest, driven by Structured Streaming.

The stream's checkpoint takes the place of a high-water mark. A batch that is repeated after a
failure replaces its own rows, because the store upserts by key.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.quality import split_unreadable
from ..sources.store import ArchiveStore
from ..sources.submissions import flatten


def store_submissions(submissions: DataFrame, archive: ArchiveStore, now_epoch: int, batch: int = 0) -> None:
    """Flatten and upsert all four tables; the nested rows are parsed once.

    What cannot be stored (unreadable records, rows without a key) goes to the archive's table of
    rejected rows, with its reason and the batch.
    """
    submissions = submissions.persist()
    try:
        rejected, readable = [], submissions
        if schemas.CORRUPT in submissions.columns:
            split = split_unreadable(submissions)
            readable = split.accepted
            rejected.append(("Submission", split.rejected))
        flat = flatten(readable, now_epoch)
        for table, rows in (
            (schemas.THREADS, flat.threads),
            (schemas.MESSAGES, flat.messages),
            (schemas.POLLS, flat.polls),
            (schemas.POLL_OPTIONS, flat.poll_options),
        ):
            rejected.append((table.name, archive.replace_into(table, rows).rejected))
        archive.keep_rejected(rejected, batch)
    finally:
        submissions.unpersist()


def pull_new_submissions(
    spark: SparkSession,
    path: str,
    archive: ArchiveStore,
    checkpoint: str,
    clock: Callable[[], float] = time.time,
    files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Ingest the JSON files under `path` that earlier pulls have not seen, then stop."""
    source = (
        spark.readStream.schema(f"{schemas.SUBMISSION}, {schemas.CORRUPT} string")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )
    return (
        source.writeStream.foreachBatch(
            lambda batch, number: store_submissions(batch, archive, round(clock()), number)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
