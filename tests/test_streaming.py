"""The incremental pull."""

from __future__ import annotations

import json

from talktrace import schemas
from talktrace.sources.store import ArchiveStore
from talktrace.streaming.incremental import pull_new_submissions, store_submissions


def test_only_new_files_are_pulled(spark, tmp_path, rows):
    archive = ArchiveStore(spark, "test_stream", buckets=2)
    archive.create_all()
    inbox, seen = tmp_path / "inbox", str(tmp_path / "seen")
    inbox.mkdir()

    def pull(name, now, **submission):
        (inbox / name).write_text(json.dumps(submission))
        pull_new_submissions(spark, str(inbox), archive, seen, clock=lambda: now).awaitTermination()

    pull("1.json", 10, id="p1", title="a", created_utc=1, comments=[{"kind": "comment", "id": "c1", "body": "x"}])
    pull("2.json", 20, id="p2", title="b", created_utc=2, comments=[{"kind": "comment", "id": "c1", "body": "y"}])
    assert rows(archive.scan(schemas.THREADS), "PostID", "insertionTimestamp") == {("p1", 10), ("p2", 20)}
    assert rows(archive.scan(schemas.MESSAGES), "CommentID", "body") == {("c1", "y")}
    archive.drop_all()


def test_nothing_is_lost(spark, tmp_path, rows):
    archive = ArchiveStore(spark, "test_stream_rejects", buckets=2)
    archive.create_all()
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    long, url = "x" * 70_000, "u" * 300
    comments = [{"kind": "comment", "id": "c1", "body": long}, {"kind": "comment", "body": "no id"}]
    lines = [json.dumps({"id": "p1", "title": "a", "url": url, "created_utc": 2**40, "comments": comments}), '{"id": "p2", "created_utc": "notanumber"}', "{broken"]
    (inbox / "1.json").write_text("\n".join(lines))
    pull_new_submissions(spark, str(inbox), archive, str(tmp_path / "seen"), clock=lambda: 10).awaitTermination()
    assert rows(archive.scan(schemas.THREADS), "PostID", "linkUrl", "createdDate") == {("p1", url, 2**40)}
    assert rows(archive.scan(schemas.MESSAGES), "CommentID", "body") == {("c1", long)}
    expected = {("Submission", "record is unreadable"), ("Comment", "CommentID is null")}
    assert rows(archive.rejected(), "table_name", "reason") == expected and archive.rejected().count() == 3
    batch = spark.read.schema(schemas.SUBMISSION + f", {schemas.CORRUPT} string").option("columnNameOfCorruptRecord", schemas.CORRUPT).json(str(inbox))
    store_submissions(batch, archive, 10, batch=0)  # the same batch once more
    assert archive.rejected().count() == 3
    spark.sql("DROP DATABASE test_stream_rejects CASCADE")
