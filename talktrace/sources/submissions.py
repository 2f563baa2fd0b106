"""Nested submissions (a thread with its messages and an optional poll) to the four flat tables.

Each flattening reads only the nested fields it needs. The insertion time is a parameter, so that a
rerun yields the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..operators.search import postings, search, terms
from ..schemas import project_to
from ..session import written

# Fixed value: the kind of a placeholder for messages that were not fetched.
PLACEHOLDER = "more"


def _author(frame: DataFrame) -> dict[str, Column]:
    """Author columns, null for a deleted author."""
    return {"AuthorID": F.col("author.id"), "AuthorName": F.col("author.name")}


def flatten_messages(submissions: DataFrame, now_epoch: int) -> DataFrame:
    items = submissions.select(F.col("id").alias("thread_id"), F.explode("comments").alias("item"))
    real = items.where(F.col("item.kind") != PLACEHOLDER).select("thread_id", "item.*")
    return project_to(
        real,
        schemas.MESSAGE_COLUMNS,
        {"PostID": F.col("thread_id"), "insertionTimestamp": F.lit(now_epoch), **_author(real)},
    )


def flatten_threads(submissions: DataFrame, now_epoch: int) -> DataFrame:
    return project_to(
        submissions,
        schemas.THREAD_COLUMNS,
        {
            "insertionTimestamp": F.lit(now_epoch),
            "isPoll": F.col("poll_data").isNotNull(),
            **_author(submissions),
        },
    )


def _polls(submissions: DataFrame) -> DataFrame:
    return submissions.where(F.col("poll_data").isNotNull()).select(
        F.col("id").alias("thread_id"), "poll_data.*"
    )


def flatten_polls(submissions: DataFrame, now_epoch: int) -> DataFrame:
    return project_to(
        _polls(submissions),
        schemas.POLL_COLUMNS,
        {"PostID": F.col("thread_id"), "insertionTimestamp": F.lit(now_epoch)},
    )


def flatten_poll_options(submissions: DataFrame, now_epoch: int) -> DataFrame:
    options = _polls(submissions).select("thread_id", F.inline("options"))
    return project_to(
        options,
        schemas.POLL_OPTION_COLUMNS,
        {"PostID": F.col("thread_id"), "insertionTimestamp": F.lit(now_epoch)},
    )


def polls_with_options(submissions: DataFrame, now_epoch: int) -> DataFrame:
    """A row per poll option with its poll's columns, from one pass over the submissions."""
    options = _polls(submissions).select("thread_id", "total_vote_count", "voting_end_timestamp", F.inline("options"))
    columns = {c.name: c for c in (*schemas.POLL_OPTION_COLUMNS, *schemas.POLL_COLUMNS)}
    filled = {"PostID": F.col("thread_id"), "insertionTimestamp": F.lit(now_epoch)}
    return project_to(options, tuple(columns.values()), filled)


@dataclass(frozen=True)
class FlatTables:
    """The four tables of one pull; `messages` is None if they were left out."""

    threads: DataFrame
    polls: DataFrame
    poll_options: DataFrame
    messages: DataFrame | None


def flatten(submissions: DataFrame, now_epoch: int, include_messages: bool = True) -> FlatTables:
    return FlatTables(
        flatten_threads(submissions, now_epoch),
        flatten_polls(submissions, now_epoch),
        flatten_poll_options(submissions, now_epoch),
        flatten_messages(submissions, now_epoch) if include_messages else None,
    )


def created_since(submissions: DataFrame, start_epoch: int) -> DataFrame:
    """Submissions created at or after the start."""
    return submissions.where(F.col("created_utc") >= start_epoch)


def _element(kind: str, table: schemas.TableSpec, source: Callable[[str], Column | None], filled: dict[str, Column]) -> Column:
    """A row of one table with the columns of all."""
    own = {c.name: c for c in table.columns}

    def value(name: str, type_: str) -> Column:
        found = filled.get(name) if name in own else None
        if found is None and name in own and own[name].attribute is not None:
            found = source(own[name].attribute)
        return (F.lit(None) if found is None else found).cast(type_).alias(name)

    return F.struct(F.lit(kind).alias("kind"), *[value(n, t) for n, t in _ALL_COLUMNS.items()])


_ALL_COLUMNS = {c.name: c.type for table in schemas.ALL_TABLES for c in table.columns}


def flat_rows(submissions: DataFrame, now_epoch: int, include_messages: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """All records of all four tables as rows of one: `kind` (thread, message, poll, option) and every table's columns, null
    where a kind has none, after the submission's columns to `carry`. The nested rows are read and parsed once.
    """
    now, thread = F.lit(now_epoch), F.col("id")

    def author(of: Column | None = None) -> dict[str, Column]:
        who = F.col("author") if of is None else of["author"]
        return {"AuthorID": who["id"], "AuthorName": who["name"]}

    def top(name: str) -> Column | None:
        return F.col(f"`{name}`") if name in submissions.columns else None

    poll = F.col("poll_data")
    shared = {"PostID": thread, "insertionTimestamp": now}
    of_thread = _element("thread", schemas.THREADS, top, {"insertionTimestamp": now, "isPoll": poll.isNotNull(), **author()})
    of_poll = _element("poll", schemas.POLLS, lambda name: poll[name], shared)
    options = F.transform(poll["options"], lambda o: _element("option", schemas.POLL_OPTIONS, lambda name: o[name], shared))
    none = F.array().cast(f"array<struct<kind: string, {', '.join(f'{n}: {t}' for n, t in _ALL_COLUMNS.items())}>>")
    parts = [F.array(of_thread), F.when(poll.isNotNull(), F.array(of_poll)), options]
    if include_messages:
        real = F.filter("comments", lambda c: c["kind"] != PLACEHOLDER)
        parts.append(F.transform(real, lambda c: _element("message", schemas.MESSAGES, lambda name: c[name], {**shared, **author(c)})))
    rows = F.concat(*[F.coalesce(p, none) for p in parts])
    # From a conditional Spark infers no filter that would build the array once more.
    return submissions.select(*carry, F.inline(F.when(F.length(F.coalesce(thread, F.lit(""))) >= 0, rows)))


def ingest_since(submissions: DataFrame, start_epoch: int, now_epoch: int) -> FlatTables:
    """Everything of the submissions created at or after the start."""
    return flatten(created_since(submissions, start_epoch), now_epoch)


def search_threads(submissions: DataFrame, query: str, start_epoch: int | None = None) -> DataFrame:
    """Submissions whose title contains the query text in any case; `*` matches all."""
    found = submissions
    if query != "*":
        found = found.where(F.lower("title").contains(F.lower(F.lit(query))))
    return found if start_epoch is None else created_since(found, start_epoch)


def ranked_pull(
    submissions: DataFrame, query: str, now_epoch: int, k: int = 100, start_epoch: int | None = None, include_messages: bool = True
) -> DataFrame:
    """`rank` and the `flat_rows` of the k threads whose title and own text suit the query best, by BM25, ties to the smaller id.

    Only threads created at or after the start are searched and counted, in contrast to a search whose results are
    filtered by time afterwards. A thread without an id, a title or a text that the query's terms occur in is not found, nor is
    any by a query without a term; submissions that share an id are ranked by all their texts and are all given.

    Searching reads ids, titles and own texts, and keeps the postings of the query's terms; the nested rows are read for the k found alone, which are few enough to
    broadcast whatever the number of threads.
    """
    able = submissions.where(F.col("id").isNotNull())
    able = able if start_epoch is None else created_since(able, start_epoch)
    texts = able.select("id", F.concat_ws(" ", "title", "selftext").alias("body"))
    asked = submissions.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))
    words = asked.select(terms("query")).first()[0]
    ranked = written(search(written(postings(texts, "id", carry=(), only=words)), asked, k, "id").select("id", "rank"))
    return flat_rows(able.join(F.broadcast(ranked), "id"), now_epoch, include_messages, carry=["rank"])


def thread_by_id(
    submissions: DataFrame, thread_id: str, now_epoch: int, include_messages: bool = True
) -> FlatTables:
    """One submission's tables by id."""
    return flatten(submissions.where(F.col("id") == thread_id), now_epoch, include_messages)


def thread_by_url(
    submissions: DataFrame, url: str, now_epoch: int, include_messages: bool = True
) -> FlatTables:
    """One submission's tables by url."""
    return flatten(submissions.where(F.col("url") == url), now_epoch, include_messages)
