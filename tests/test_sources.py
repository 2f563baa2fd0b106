"""Files, nested submissions, load checks and the store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from talktrace import schemas
from talktrace.sources import files, quality, store, submissions

ORIGIN = 1_704_067_200


def header(ddl):
    return ",".join(column.split()[0] for column in ddl.split(", "))


def test_csv_inputs(spark, tmp_path, rows):
    messages = tmp_path / "messages.csv"
    messages.write_text(
        f"{header(schemas.MESSAGE_CSV)}\n"
        f'c1,p1,/c1,a1,Ann,{ORIGIN},"two\nlines, ""quoted""",3,t3,{ORIGIN + 5},0.5\n'
        f"c2,p1,/c2,,,{ORIGIN + 86400},plain,1,t3,{ORIGIN + 5},-0.25\n"
    )
    loaded = files.load_messages(spark, str(messages), ORIGIN)
    assert rows(loaded, "message_id", "author", "body", "day", "compound") == {
        ("c1", "Ann", 'two\nlines, "quoted"', 1, 0.5),
        ("c2", None, "plain", 2, -0.25),
    }
    assert str(files.message_table(loaded).orderBy("Day").first()["Date"]) == "2024-01-01 00:00:00"
    assert files.season_length(loaded, ORIGIN).first()[0] == 2

    threads = tmp_path / "threads.csv"
    names = [c.name for c in schemas.THREAD_COLUMNS[:-1]]
    values = dict.fromkeys(names, "") | {"PostID": "p1", "title": "Daily Discussion", "createdDate": ORIGIN + 90000}
    threads.write_text(",".join(names) + "\n" + ",".join(str(values[n]) for n in names) + "\n")
    shown = files.thread_table(files.load_threads(spark, str(threads)), ORIGIN).first()
    assert (shown["Day"], shown["Type of Discussion Thread"]) == (2, "MID")

    people = tmp_path / "roster.csv"
    people.write_text(
        f"{header(schemas.ROSTER_CSV)}\n"
        '"Gab ""G"" Jay",24,Town,1,,,1\n'
    )
    assert rows(files.load_roster(spark, str(people)), "entity", "entry_day", "leave_day") == {('Gab "G" Jay', 1, None)}

    timeline = tmp_path / "timeline.csv"
    timeline.write_text("Day,Type,Summary,Islanders\n3,Exits,someone left,Ann\n")
    assert rows(files.load_timeline(spark, str(timeline)), "day", "type", "entity") == {(3, "Exits", "Ann")}

    names = tmp_path / "names.csv"
    names.write_bytes("﻿Islander,,,,\r\nAnn Lee,Ann,Annie,,\r\nBob Ray,Bob,Ann,,\r\n".encode())
    assert rows(files.load_aliases(spark, str(names)), "alias", "entity") == {
        ("Ann", "Bob Ray"), ("Annie", "Ann Lee"), ("Bob", "Bob Ray"),
    }

    raw = files.load_raw(spark, *map(str, (messages, threads, people, timeline, names)), ORIGIN)
    assert raw.messages.count() == 2 and raw.timeline.count() == 1


def test_unreadable_rows_are_marked(spark, tmp_path, rows):
    path = tmp_path / "t.csv"
    path.write_text("Day,Type,Summary,Islanders\n3,Exits,left,Ann\nx,Exits,left,Bob\n")
    for multi_line in (False, True):
        got = files.read_csv(spark, str(path), schemas.TIMELINE_CSV, multi_line)
        assert rows(got.accepted, "Islanders") == {("Ann",)} and got.accepted.select("Type").count() == 1
        assert rows(got.rejected, "record") == {("x,Exits,left,Bob",)}
    assert rows(files.load_timeline(spark, str(path)), "day", "entity") == {(3, "Ann")}


def test_unreadable_rows_of_all_inputs_are_given(spark, tmp_path, rows):
    for name, ddl, line in (
        ("messages", schemas.MESSAGE_CSV, "c1,p1,l,a,Ann,notanumber,hi,1,p1,5,0.5"),
        ("threads", schemas.THREAD_CSV, "p1,n,t,l,1,a,Ann,true,f,u,false,2,3,s,4,0.5,6"),
        ("roster", schemas.ROSTER_CSV, "Ann,20,Town,1,2,Dumped,1"),
        ("timeline", schemas.TIMELINE_CSV, "3,Exits,left,Ann"),
    ):
        (tmp_path / f"{name}.csv").write_text(f"{header(ddl)}\n{line}\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("messages", "threads", "roster", "timeline")]
    assert rows(files.rejected_rows(spark, *paths), "table_name") == {("messages",)}


def test_alias_order_follows_the_paths_of_several_files(spark, tmp_path, rows):
    (tmp_path / "b.csv").write_text("e,a1,a2,a3,a4\nLast,Shared,,,\n")
    (tmp_path / "a.csv").write_text("e,a1,a2,a3,a4\nFirst,Shared,,,\n" + "".join(f"N{i},A{i},,,\n" for i in range(300)))
    assert ("Shared", "Last") in rows(files.load_aliases(spark, str(tmp_path / "*.csv")), "alias", "entity")


SUBMISSIONS = [
    {
        "id": "p1", "title": "Post Episode", "created_utc": 100, "url": "u1", "author": {"id": "a1", "name": "Ann"},
        "comments": [
            {"kind": "comment", "id": "c1", "body": "hi", "author": {"id": "a2", "name": "Bob"}, "created_utc": 101},
            {"kind": "comment", "id": "c2", "body": "gone", "created_utc": 102},
            {"kind": "more", "id": "c3"},
        ],
        "poll_data": {"total_vote_count": 3, "voting_end_timestamp": 200,
                      "options": [{"id": "o1", "text": "yes", "vote_count": 2}, {"id": "o2", "text": "no", "vote_count": 1}]},
    },
    {"id": "p2", "title": "Daily Discussion", "created_utc": 50, "url": "u2", "comments": []},
]


@pytest.fixture
def nested(spark, tmp_path):
    path = tmp_path / "submissions.json"
    path.write_text("\n".join(map(json.dumps, SUBMISSIONS)))
    return spark.read.schema(schemas.SUBMISSION).json(str(path))


def test_flattening(nested, rows):
    flat = submissions.flatten(nested, 999)
    assert rows(flat.messages, "CommentID", "PostID", "AuthorName", "body", "insertionTimestamp") == {
        ("c1", "p1", "Bob", "hi", 999), ("c2", "p1", None, "gone", 999),
    }
    assert rows(flat.threads, "PostID", "AuthorID", "isPoll", "score") == {("p1", "a1", True, None), ("p2", None, False, None)}
    assert rows(flat.polls, "PostID", "totalVoteCount") == {("p1", 3)}
    assert rows(flat.poll_options, "PollOptionID", "PostID", "voteCount") == {("o1", "p1", 2), ("o2", "p1", 1)}
    assert flat.messages.columns == [c.name for c in schemas.MESSAGE_COLUMNS]


def test_pulls_searches_and_lookups(nested, rows):
    assert rows(submissions.ingest_since(nested, 100, 9).threads, "PostID") == {("p1",)}
    assert rows(submissions.search_threads(nested, "DISCUSSION"), "id") == {("p2",)}
    assert submissions.search_threads(nested, "*").count() == 2
    assert submissions.search_threads(nested, "*", 60).count() == 1
    one = submissions.thread_by_id(nested, "p1", 9, include_messages=False)
    assert one.messages is None and one.threads.count() == 1
    assert submissions.thread_by_url(nested, "u2", 9).messages.count() == 0


def test_ranked_pull_gives_all_tables_of_the_best_threads(spark, nested, rows):
    found = submissions.ranked_pull(nested, "daily DISCUSSION of cats", 9)
    assert rows(found, "rank", "kind", "PostID") == {(1, "thread", "p2")}
    both = submissions.ranked_pull(nested.withColumn("selftext", F.lit("cats")), "daily cats", 9)
    assert rows(both, "rank", "kind", "CommentID", "PollOptionID") == {
        (1, "thread", None, None), (2, "thread", None, None), (2, "message", "c1", None), (2, "message", "c2", None),
        (2, "poll", None, None), (2, "option", None, "o1"), (2, "option", None, "o2"),
    }
    assert rows(submissions.ranked_pull(nested.withColumn("selftext", F.lit("cats")), "cats", 9, 1, 60, False), "kind") == {("thread",), ("poll",), ("option",)}
    for nothing in ("*", "", "absent"):
        assert submissions.ranked_pull(nested, nothing, 9).count() == 0
    assert submissions.ranked_pull(nested.limit(0), "daily", 9).count() == 0
    unnamed = nested.withColumn("id", F.lit(None).cast("string"))
    assert submissions.ranked_pull(unnamed, "daily", 9).count() == 0


def _options(spark, *data):
    return spark.createDataFrame(
        list(data), "PollOptionID string, PostID string, text string, voteCount long, insertionTimestamp long"
    )


def test_bad_rows_are_kept_aside(spark, rows):
    data = _options(spark, ("a", "p", "x", 1, 1), (None, "p", "x", 1, 1), ("b", "p", "x" * 70_000, 1, 1), ("c", "p", "x", 2**40, 1))
    checked = quality.check_rows(data, schemas.POLL_OPTIONS)
    assert rows(checked.accepted, "PollOptionID") == {("a",), ("b",), ("c",)}
    assert rows(checked.rejected, "reason") == {("PollOptionID is null",)}
    summary = {r["outcome"]: r["n_rows"] for r in quality.load_summary(data, schemas.POLL_OPTIONS).collect()}
    assert summary == {"accepted": 3, "PollOptionID is null": 1}


def test_ties_of_one_load_do_not_depend_on_order(spark, rows):
    data = [("k", 5, "older", 9), ("k", 6, "newer", 9), ("k", 6, "also", 9)]
    for order in (data, data[::-1]):
        frame = spark.createDataFrame(order, "k string, createdDate long, v string, seq int").repartition(3)
        assert rows(store.latest_rows(frame, "k", "seq"), "v") == {("newer",)}


def test_upsert_keeps_the_last_load(spark, rows):
    frame = lambda *data: spark.createDataFrame(list(data), "k int, v string, seq int")
    base, delta = frame((1, "a", 1), (2, "b", 1)), frame((2, "c", 2), (2, "d", 3), (4, "e", 2))
    merged = store.upsert_latest(base, delta, "k", "seq")
    assert rows(merged, "k", "v") == {(1, "a"), (2, "d"), (4, "e")}
    again = store.upsert_latest(merged, delta, "k", "seq")
    assert rows(again, "k", "v", "seq") == rows(merged, "k", "v", "seq")
    few = store.upsert_latest(base, delta, "k", "seq", few_keys=True)
    assert rows(few, "k", "v", "seq") == rows(merged, "k", "v", "seq")


@pytest.mark.parametrize("broadcast_bytes", [0, store.MAX_BROADCAST_BYTES])
def test_store(spark, nested, rows, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(store, "MAX_BROADCAST_BYTES", broadcast_bytes)
    archive = store.ArchiveStore(spark, "test_archive", buckets=3)
    archive.create_all()
    archive.create_all()
    flat = submissions.flatten(nested, 999)
    for table, frame in zip(schemas.ALL_TABLES, (flat.threads, flat.messages, flat.polls, flat.poll_options)):
        assert archive.replace_into(table, frame).rejected.count() == 0
    assert rows(archive.thread_ids(), "PostID") == {("p1",), ("p2",)}
    assert archive.last_insertion() == 999
    later = flat.messages.where("CommentID = 'c2'").withColumns(
        {"body": F.lit("edited"), "insertionTimestamp": F.lit(1000).cast("long")}
    )
    archive.replace_into(schemas.MESSAGES, later)
    assert rows(archive.scan(schemas.MESSAGES), "CommentID", "body") == {("c1", "hi"), ("c2", "edited")}
    assert archive.scan(schemas.MESSAGES).columns == schemas.MESSAGES.column_names
    between = lambda *bounds: rows(archive.created_between(schemas.MESSAGES, *bounds), "CommentID")
    assert between(101) == {("c2",)} and between(101, 102) == set() and between(100, 102) == {("c1",)}
    plan = archive.created_between(schemas.MESSAGES, 100, 102)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(createdDate,100), LessThan(createdDate,102)" in plan
    many = _options(spark, *[(f"o{i}", "p1", "new", i, 1000) for i in range(30)])
    archive.replace_into(schemas.POLL_OPTIONS, many)
    archive.replace_into(schemas.POLL_OPTIONS, many.where("PollOptionID = 'o7'").withColumn("text", F.lit("last")))
    texts = {r["text"]: r["count"] for r in archive.scan(schemas.POLL_OPTIONS).groupBy("text").count().collect()}
    assert texts == {"new": 29, "last": 1}
    wanted = archive.thread_ids().where("PostID = 'p1'")
    assert archive.messages_for_threads(wanted).count() == 2
    archive.drop_all()
    assert not spark.catalog.tableExists("test_archive.Post")


@pytest.mark.parametrize("broadcast_bytes", [0, store.MAX_BROADCAST_BYTES])
def test_small_pulls_touch_few_days_and_ranges_prune(spark, rows, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(store, "MAX_BROADCAST_BYTES", broadcast_bytes)
    archive, day = store.ArchiveStore(spark, f"test_days_{broadcast_bytes}"), 86_400
    archive.create_all()
    columns = ", ".join(f"{c.name} {c.type}" for c in schemas.MESSAGE_COLUMNS)

    def load(*data):
        frame = spark.createDataFrame([(k, "p", None, None, None, t, b, 0, None, seq) for k, t, b, seq in data], columns)
        archive.replace_into(schemas.MESSAGES, frame)

    def files():
        found = spark.table(archive._name(schemas.MESSAGES)).select("created_day", "_metadata.file_path").distinct()
        return {r[0]: r[1] for r in found.collect()}

    load(*[(f"c{d}", d * day + 5, "first", 1) for d in range(10)], ("n", None, "no time", 1))
    before = files()
    assert len(before) == 11
    load(("c3", 3 * day + 5, "again", 2), ("new", 3 * day + 9, "new", 2))
    after = files()
    assert {d for d in after if after[d] != before.get(d)} == {3}
    load(("c5", 7 * day, "moved", 3), ("n", None, "still", 3))
    moved = files()
    assert 5 not in moved and {d for d in moved if moved[d] != after.get(d)} == {7, store.NO_DAY}
    assert rows(archive.scan(schemas.MESSAGES).where("CommentID IN ('c3', 'c5', 'n')"), "CommentID", "body") == {
        ("c3", "again"), ("c5", "moved"), ("n", "still")}
    assert archive.scan(schemas.MESSAGES).count() == 12
    found = archive.created_between(schemas.MESSAGES, 2 * day, 4 * day)
    assert rows(found, "CommentID") == {("c2",), ("c3",), ("new",)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "created_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    archive.drop_all()


def test_materialised(spark, rows):
    kept, built = store.Materialised(spark, "test_analytics"), []

    def build(value):
        def make():
            built.append(value)
            return spark.createDataFrame([(1, value), (2, value)], "day int, n int")

        return make

    assert rows(kept.load("t", build(1)), "day", "n") == {(1, 1), (2, 1)}
    assert rows(kept.load("t", build(2), hold=True), "n") == {(1,)}
    assert rows(kept.load("t", build(3), hold=True), "n") == {(1,)}
    assert rows(kept.load("t", build(4), force=True), "n") == {(4,)}
    assert built == [1, 4]
    with pytest.raises(ZeroDivisionError):
        kept.load("t", lambda: 1 / 0, force=True)
    assert rows(kept.load("t", build(9)), "n") == {(4,)}
    assert "PartitionFilters: [isnotnull(day" in kept.load("t", build(5)).where("day = 1")._jdf.queryExecution().executedPlan().toString()


def test_written_files_are_read_back(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    data = [(1, "t", ' "quoted", with, commas ', "", "x"), (2, "u", "two\nlines", "  kept  ", "y"), (3, "v", "end\\", "z", "w")]
    frame = spark.createDataFrame(data, "Day int, Type string, Summary string, Islanders string, extra string").drop("extra")
    files.write_csv(frame, path)
    back = files.read_csv(spark, path, schemas.TIMELINE_CSV, multi_line=True)
    assert rows(back.accepted, "Day", "Type", "Summary", "Islanders") == {tuple(v or None for v in row[:4]) for row in data}
    assert back.rejected.isEmpty()


def test_rows_are_shuffled_for_repeated_keys_alone(spark, rows):
    """All rows used to be, with their values twice."""
    columns = ("k", "seq", "v")
    once = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "k string, seq long, v string")
    same = store._latest_of_repeated(once, "k", "seq")
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString()
    assert rows(same, *columns) == {("a", 1, "x"), ("b", 1, None)}
    more = once.union(spark.createDataFrame([("a", 2, None), ("a", 2, "y"), ("a", None, "z"), ("c", None, None)], once.schema))
    assert rows(store._latest_of_repeated(more, "k", "seq"), *columns) == {("a", 2, "y"), ("b", 1, None), ("c", None, None)}
    assert rows(store.latest_rows(more, "k", "seq"), *columns) == {("a", 2, "y"), ("b", 1, None), ("c", None, None)}


@pytest.mark.parametrize("most", [0, 1 << 27])
def test_pulls_give_the_same_archive_whether_keys_are_broadcast_or_not(spark, rows, monkeypatch, most):
    monkeypatch.setattr(store, "MAX_BROADCAST_BYTES", most)
    archive = store.ArchiveStore(spark, f"keys_{most}")
    archive.create(schemas.THREADS)

    def pull(now, *threads):
        data = [(i, created, title, now) for i, created, title in threads]
        frame = spark.createDataFrame(data, "PostID string, createdDate long, title string, insertionTimestamp long")
        for c in schemas.THREADS.columns:
            if c.name not in frame.columns:
                frame = frame.withColumn(c.name, F.lit(None).cast(c.type))
        archive.replace_into(schemas.THREADS, frame)

    pull(1, ("a", 10, "one"), ("b", 20, "two"), ("c", 90_000, "three"), ("a", 10, "onf"))
    pull(2, ("b", 20, "new"), ("d", 30, "four"), ("c", 200_000, "moved"))
    assert rows(archive.scan(schemas.THREADS), "PostID", "createdDate", "title", "insertionTimestamp") == {
        ("a", 10, "onf", 1), ("b", 20, "new", 2), ("d", 30, "four", 2), ("c", 200_000, "moved", 2)}
    archive.drop(schemas.THREADS)
