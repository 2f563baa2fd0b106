"""State per key with expiry: the latest version of each message, and how long an entity was not mentioned.

Both forget a key when event time has passed it by: a version after `keep` seconds without a newer one, the moments
of an entity once the watermark has passed them. What is kept is one version of a key, or one moment and those that the
watermark has not passed yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_VERSION = "message_id bigint, sequence bigint, record string"


def latest_versions(messages: DataFrame, key: str, sequence: str, event_time: str, delay: int, keep: int) -> DataFrame:
    """key, sequence and the columns of each message version that is newer than all before it, from a stream.

    Of versions with one sequence the one whose values are greatest as JSON is the newer. `event_time` names epoch
    seconds; `delay` and `keep` are seconds. The last emitted row of each key is its latest version: `latest_of` reads it.
    """
    columns = [c for c in messages.columns]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    timed = messages.select(
        F.col(key).cast("bigint").alias("message_id"), F.col(sequence).cast("bigint").alias("sequence"), record.alias("record"),
        F.timestamp_seconds(event_time).alias("time"),
    ).withWatermark("time", f"{delay} seconds")

    def newest(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = tuple(state.get) if state.exists else None
        best, latest = before, state.getCurrentWatermarkMs()
        for frame in frames:
            own = max(zip(frame["sequence"].tolist(), frame["record"].tolist()))
            best = own if best is None or own > best else best
            latest = max(latest, int(frame["time"].max().timestamp() * 1000))
        state.update(best)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep * 1000)
        if best != before:
            yield pd.DataFrame({"message_id": [name[0]], "sequence": [best[0]], "record": [best[1]]})

    return timed.groupBy("message_id").applyInPandasWithState(
        newest, _VERSION, "sequence bigint, record string", "append", GroupStateTimeout.EventTimeTimeout)


def latest_of(emitted: DataFrame, schema: str) -> DataFrame:
    """The latest version of each key among emitted rows, with the messages' columns."""
    last = emitted.groupBy("message_id").agg(F.max_by("record", F.struct("sequence", "record")).alias("record"))
    return last.select(F.from_json("record", schema).alias("row")).select("row.*")


def silences(mentions: DataFrame, event_time: str, delay: int, least: int) -> DataFrame:
    """entity, since, until, seconds: stretches of `least` seconds or more between two successive mentions, from a stream
    of mention rows (entity, `event_time` in epoch seconds).

    Mentions may come in any order within `delay` seconds; later ones are left out. A stretch is emitted once the
    watermark has passed its end, so that nothing can fall into it any more.
    """
    timed = mentions.select("entity", F.timestamp_seconds(event_time).alias("time")).withWatermark("time", f"{delay} seconds")

    def settle(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, "")
        moments = {int(m) for m in waiting.split(",") if m}
        if not state.hasTimedOut:
            for frame in frames:
                moments |= set((frame["time"].astype("int64") // 10**_digits(frame["time"])).tolist())
        mark = state.getCurrentWatermarkMs() // 1000
        found = []
        for moment in sorted(m for m in moments if m < mark):
            if last is not None and moment - last >= least:
                found.append((name[0], last, moment, moment - last))
            last = moment if last is None else max(last, moment)
        left = sorted(m for m in moments if m >= mark)
        state.update((last, ",".join(map(str, left))))
        if left:
            state.setTimeoutTimestamp(max((left[0] + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=["entity", "since", "until", "seconds"])

    return timed.groupBy("entity").applyInPandasWithState(
        settle, "entity string, since bigint, until bigint, seconds bigint", "last bigint, waiting string", "append",
        GroupStateTimeout.EventTimeTimeout)


def _digits(times: pd.Series) -> int:
    """Decimal digits below a second in the series' unit."""
    return {"s": 0, "ms": 3, "us": 6, "ns": 9}[times.dt.unit]


def silences_of(rows: DataFrame, event_time: str, least: int) -> DataFrame:
    """The same over a table of mention rows: entity, since, until, seconds.

    Moments are made distinct per entity first, and lie in order by day: what a day takes over from the days before
    is one row per entity and day, so no task sorts all of an entity's moments.
    """
    day = 86_400
    moments = rows.select("entity", F.col(event_time).alias("moment")).distinct().withColumn("day", F.floor(F.col("moment") / day))
    ends = moments.groupBy("entity", "day").agg(F.min("moment").alias("first"), F.max("moment").alias("last"))
    by_day = Window.partitionBy("entity").orderBy("day")
    between = ends.select("entity", F.lag("last").over(by_day).alias("since"), F.col("first").alias("until"))
    in_day = Window.partitionBy("entity", "day").orderBy("moment")
    within = moments.select("entity", F.lag("moment").over(in_day).alias("since"), F.col("moment").alias("until"))
    gaps = between.unionByName(within).where(F.col("until") - F.col("since") >= least)
    return gaps.withColumn("seconds", F.col("until") - F.col("since"))
