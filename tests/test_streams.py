"""Windows, late rows and keyed state of streams, against batch results and simulations."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talktrace.operators.aliases import AliasBook
from talktrace.operators.mentions import mention_rows, scan_mentions
from talktrace.streaming import state, windows

BOOK = AliasBook((("cat", "Cat"), ("dog", "Dog"), ("hen", "Hen")))
HOUR = 3_600
ORIGIN = 1_704_067_200
SCHEMA = "message_id bigint, created_epoch bigint, body string"


def _batches(seed, number=5, size=40):
    """Batches of messages that move on in time, with some that are old."""
    draw, key, out = random.Random(seed), 0, []
    for b in range(number):
        rows = []
        for _ in range(size):
            key += 1
            behind = draw.choice([0, 0, 0, 4, 30]) * HOUR
            at = ORIGIN + b * 10 * HOUR + draw.randint(0, 10 * HOUR) - behind
            rows.append((key, at if draw.random() > 0.02 else None, " ".join(draw.choices(["cat", "dog", "hen", "fish", "cat dog"], k=3))))
        draw.shuffle(rows)
        out.append(rows)
    return out


def _put(folder, name, rows, columns=("message_id", "created_epoch", "body")):
    folder.mkdir(exist_ok=True)
    lines = "\n".join(json.dumps(dict(zip(columns, r))) for r in rows)
    (folder / f"{name}.json").write_text(lines)


def _expected(spark, batches, delay):
    """Mention rows on time and late ids, by the rule: older than the newest on-time message of earlier batches."""
    newest, on_time, late = None, [], set()
    for rows in batches:
        mark = None if newest is None else newest - delay
        able = [r for r in rows if r[1] is not None and (mark is None or r[1] >= mark)]
        late |= {r[0] for r in rows} - {r[0] for r in able}
        on_time += able
        newest = max([r[1] for r in able] + ([newest] if newest is not None else []), default=None)
    scanned = scan_mentions(spark.createDataFrame(on_time, SCHEMA), BOOK, carry=("created_epoch",))
    return mention_rows(scanned).select("message_id", "created_epoch", "entity", "n"), late, newest


def test_sliding_counts_of_a_replayed_stream(spark, tmp_path, rows, monkeypatch):
    source, delay = tmp_path / "in", 6 * HOUR
    batches = _batches(1)
    stream = windows.MentionStream(spark, str(tmp_path / "tables"), BOOK, delay)

    def read():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))

    for number, batch in enumerate(batches[:2]):
        _put(source, f"b{number}", batch)
        stream.pull(read)
    _put(source, "b2", batches[2])
    original = windows.MentionStream._path
    monkeypatch.setattr(windows.MentionStream, "_path", lambda self, t, b=None: 1 / 0 if t == "progress" and b == 2 else original(self, t, b))
    with pytest.raises(Exception):  # fails after the batch's mentions are written
        stream.pull(read)
    monkeypatch.undo()
    again = windows.MentionStream(spark, str(tmp_path / "tables"), BOOK, delay)  # as after a restart
    again.pull(read)
    for number, batch in enumerate(batches[3:], 3):
        _put(source, f"b{number}", batch)
        count = again.pull(read)
    on_time, late, newest = _expected(spark, batches, delay)
    columns = ("start", "entity", "messages", "n")
    assert rows(again.counts(), *columns) == rows(windows.sliding_mentions(on_time), *columns)
    closed = windows.sliding_mentions(on_time).where(F.col("start") + 24 * HOUR <= newest - delay)
    assert rows(again.counts(newest - delay), *columns) == rows(closed, *columns)
    assert Counter(r.message_id for r in again.late().collect()) == Counter(late) and late
    held = count.lastProgress["stateOperators"][0]
    assert held["numRowsTotal"] <= 3 * (24 + 16) // 6 * 2 and held["numRowsDroppedByWatermark"] == 0


def test_sliding_windows_hold_their_size(spark):
    with pytest.raises(ValueError):
        windows.sliding_mentions(spark.createDataFrame([], "created_epoch bigint, entity string, n bigint"), 10, 3)


def _collect(frame, folder, mode="append"):
    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = frame.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_versions_equal_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    kind = "message_id bigint, inserted bigint, at bigint, body string"
    rows = [(draw.randint(1, 30), draw.randint(1, 60), ORIGIN + draw.randint(0, 5 * HOUR), draw.choice(["a", "b", "c"])) for _ in range(300)]
    rows += [(99, 1, ORIGIN + 2 * HOUR, None)]
    for number in range(6):
        _put(tmp_path / "in", f"b{number}", rows[number::6], ("message_id", "inserted", "at", "body"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    _collect(state.latest_versions(source, "message_id", "inserted", "at", 10 * HOUR, HOUR), tmp_path)
    emitted = spark.read.schema("message_id bigint, sequence bigint, record string, batch bigint").parquet(str(tmp_path / "out"))
    got = {r.message_id: tuple(r) for r in state.latest_of(emitted, kind).collect()}
    top = {k: max(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    assert set(got) == set(top) and all(got[k] in rows and got[k][1] == top[k] for k in top)
    later = [(1_000 + i, 1, ORIGIN + 1_000 * HOUR, "z") for i in range(3)], [(2_000, 1, ORIGIN + 2_000 * HOUR, "z")], [(2_001, 1, ORIGIN + 2_001 * HOUR, "z")]
    for number, more in enumerate(later, 7):
        _put(tmp_path / "in", f"b{number}", more, ("message_id", "inserted", "at", "body"))
        query = _collect(state.latest_versions(source, "message_id", "inserted", "at", 10 * HOUR, HOUR), tmp_path)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # all but the last keys have expired
    assert {r.message_id: tuple(r) for r in state.latest_of(emitted, kind).where("message_id < 1000").collect()} == got


@pytest.mark.parametrize("seed", [3, 4])
def test_silences_equal_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    moments = sorted((ORIGIN + draw.randint(0, 60 * HOUR), draw.choice(["Cat", "Cat", "Dog"])) for _ in range(200))
    disordered = sorted(moments, key=lambda m: m[0] + draw.randint(0, 2 * HOUR))  # within the delay
    for number in range(5):
        _put(tmp_path / "in", f"b{number}", [(e, t) for t, e in disordered[40 * number : 40 * number + 40]], ("entity", "t"))
    source = spark.readStream.schema("entity string, t bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    _collect(state.silences(source, "t", 3 * HOUR, HOUR), tmp_path)
    end = ORIGIN + 1_000 * HOUR
    _put(tmp_path / "in", "b8", [("Hen", end)], ("entity", "t"))  # moves the watermark past all
    query = _collect(state.silences(source, "t", 3 * HOUR, HOUR), tmp_path)
    got = spark.read.schema("entity string, since bigint, until bigint, seconds bigint, batch bigint").parquet(str(tmp_path / "out")).drop("batch")
    table = spark.createDataFrame([(e, t) for t, e in moments], "entity string, t bigint")
    expected = state.silences_of(table, "t", HOUR).select("entity", "since", "until", "seconds")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected.collect())) and expected.count() > 3
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
