"""Every query on the driver's tables, with its SQL equivalent beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import calendar, labels
from ..operators import (
    aliases,
    centrality,
    codes,
    comentions,
    daily,
    mentions,
    moments,
    paths,
    postexit,
    roster,
    search,
    sentiment,
    summaries,
    temporal,
    timeline,
)
from ..schemas import ColumnSpec, MESSAGE_COLUMNS, MESSAGES, THREADS, TableSpec, project_to
from ..session import checkpoint_folder, ensure_checkpoint_dir, local_table, written
from ..sources import files, quality, store, submissions
from ..streaming import state, windows
from . import stored, views
from .views import CREATED_SQL, FIRST, LAST, NOW, ORIGIN, TITLE_SQL, sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = oracle
        return function

    return register


def _round(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


def _text_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _time_sql(epoch: str) -> str:
    return f"strftime(make_timestamp(({epoch}) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _scan(spark: SparkSession, sf_dir: str, boundary: str = "word", carry: tuple = ("day",)) -> DataFrame:
    return mentions.scan_mentions(views.messages(spark, sf_dir), views.book(), boundary, carry)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mention_rows(_scan(spark, sf_dir, carry=("day", "compound")))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mention_sets(_scan(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_mentions(_rows(spark, sf_dir))


def _sentiment(spark: SparkSession, sf_dir: str, mode: str = "mentioned") -> DataFrame:
    return sentiment.daily_sentiment(_rows(spark, sf_dir), mode)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comentions.edges_total(comentions.edges_daily(_sets(spark, sf_dir)), FIRST, LAST)


POPULATION = len(views.ENTITIES)

# ---------------------------------------------------------------- sources, sinks, ingest


@query(sql("messages", f"""
    SELECT message_id, thread_id, created_epoch, day, body, author, score, compound, permalink, inserted_epoch,
           {_time_sql('created_epoch')} AS created
    FROM messages"""))
def load_messages(spark, sf_dir):
    loaded = files.with_day(views.messages(spark, sf_dir), ORIGIN, "created_epoch")
    return loaded.withColumn("created", _text_time("date")).drop("date")


@query(sql("dictionary", """
    SELECT alias, entity, CAST(place[1] AS INTEGER) AS column_no, CAST(place[2] AS BIGINT) AS row_no FROM dictionary"""))
def alias_dictionary(spark, sf_dir):
    built = aliases.alias_dictionary(
        views.wide_aliases(spark, sf_dir), "entity", ["alias_1", "alias_2", "alias_3"], "row_no"
    )
    return built.select("alias", "entity", "alias_order.column_no", "alias_order.row_no")


_MESSAGE_SQL = f"""
    SELECT doc_id || '-' || i AS "CommentID", 't-' || doc_id AS "PostID",
           '/m/' || doc_id || '/' || i AS permalink,
           CASE WHEN i % 5 <> 0 THEN 'a-' || source END AS "AuthorID",
           CASE WHEN i % 5 <> 0 THEN source END AS "AuthorName",
           created + i AS "createdDate", line AS body, CAST(length(line) % 50 AS BIGINT) AS score,
           't-' || doc_id AS "parentID", CAST({NOW} AS BIGINT) AS "insertionTimestamp"
    FROM lines WHERE length(line) >= 40"""


@query(sql("lines", _MESSAGE_SQL))
def flatten_messages(spark, sf_dir):
    return submissions.flatten_messages(views.submissions(spark, sf_dir), NOW)


_THREAD_SQL = f"""
    SELECT 't-' || doc_id AS "PostID", 'n-' || doc_id AS name, {TITLE_SQL} AS title,
           '/t/' || doc_id AS permalink, {CREATED_SQL} AS "createdDate",
           CASE WHEN doc_id % 10 <> 0 THEN 'a-' || source END AS "AuthorID",
           CASE WHEN doc_id % 10 <> 0 THEN source END AS "AuthorName",
           doc_id % 50 = 0 AS "isStickied", lang AS "linkFlairText",
           'http://example.com/' || doc_id AS "linkUrl", doc_id % 20 = 0 AS "isLocked",
           CASE WHEN doc_id % 6 = 0 THEN {CREATED_SQL} + 60 END AS edited,
           CAST(len(string_split(text, chr(10))) AS BIGINT) AS "numOfComments", text AS "selfText",
           doc_id * 13 % 50 AS score, doc_id % 100 / CAST(100 AS DOUBLE) AS "upvoteRatio",
           CAST({NOW} AS BIGINT) AS "insertionTimestamp", lang = 'en' AS "isPoll"
    FROM documents"""


@query(_THREAD_SQL)
def flatten_threads(spark, sf_dir):
    return submissions.flatten_threads(views.submissions(spark, sf_dir), NOW)


@query(sql("options", f"""
    SELECT 't-' || doc_id AS "PostID", doc_id || '/' || i AS "PollOptionID", option AS text,
           CAST(length(option) % 100 AS BIGINT) AS "voteCount", doc_id * 3 AS "totalVoteCount",
           created + 86400 AS "votingEndTimestamp", CAST({NOW} AS BIGINT) AS "insertionTimestamp"
    FROM options"""))
def flatten_polls(spark, sf_dir):
    return submissions.polls_with_options(views.submissions(spark, sf_dir), NOW)


@query("""
    SELECT CAST(NULL AS VARCHAR) AS "CommentID", 'override' AS "PostID", CAST(NULL AS VARCHAR) AS permalink,
           CAST(NULL AS VARCHAR) AS "AuthorID", source AS "AuthorName", doc_id AS "createdDate", text AS body,
           n_chars AS score, CAST(NULL AS VARCHAR) AS "parentID", CAST(NULL AS BIGINT) AS "insertionTimestamp"
    FROM documents""")
def schema_project(spark, sf_dir):
    source = views.table(spark, sf_dir, "documents").select(
        F.col("text").alias("body"), F.col("n_chars").alias("score"), F.col("doc_id").alias("created_utc"), "source"
    )
    return project_to(
        source, MESSAGE_COLUMNS, {"PostID": F.lit("override"), "AuthorName": F.col("source")}
    )


_RECENCY_NOW = "2002-08-01 00:00:00"


@query(f"""
    SELECT o_orderkey AS order_key,
           CASE WHEN age <= 3600 THEN 'hour' WHEN age <= 86400 THEN 'day' WHEN age <= 604800 THEN 'week'
                WHEN age <= 2678400 THEN 'month' WHEN age <= 31536000 THEN 'year' ELSE 'all' END AS bucket
    FROM (SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '{_RECENCY_NOW}') AS age FROM orders)""")
def recency_bucket(spark, sf_dir):
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    now = F.unix_timestamp(F.lit(_RECENCY_NOW).cast("timestamp"))
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), calendar.recency_bucket(start, now).alias("bucket")
    )


_SINCE = ORIGIN + 10 * 86_400


_OPTION_SQL = f"""
    SELECT doc_id || '/' || i AS "PollOptionID", 't-' || doc_id AS "PostID", option AS text,
           CAST(length(option) % 100 AS BIGINT) AS "voteCount", CAST({NOW} AS BIGINT) AS "insertionTimestamp"
    FROM options"""
_POLL_SQL = f"""
    SELECT 't-' || doc_id AS "PostID", doc_id * 3 AS "totalVoteCount", {CREATED_SQL} + 86400 AS "votingEndTimestamp",
           CAST({NOW} AS BIGINT) AS "insertionTimestamp"
    FROM documents WHERE lang = 'en'"""


@query(sql("lines options", f"""
    SELECT 'thread' AS kind, * FROM ({_THREAD_SQL} WHERE {CREATED_SQL} >= {_SINCE})
    UNION ALL BY NAME SELECT 'message' AS kind, * FROM ({_MESSAGE_SQL} AND created >= {_SINCE})
    UNION ALL BY NAME SELECT 'poll' AS kind, * FROM ({_POLL_SQL} AND {CREATED_SQL} >= {_SINCE})
    UNION ALL BY NAME SELECT 'option' AS kind, * FROM ({_OPTION_SQL} WHERE created >= {_SINCE})"""))
def ingest_since(spark, sf_dir):
    pulled = submissions.created_since(views.submissions(spark, sf_dir), _SINCE)
    return submissions.flat_rows(pulled, NOW)


@query(f"""
    {_THREAD_SQL} WHERE lower({TITLE_SQL}) LIKE '%discussion post%' AND {CREATED_SQL} >= {_SINCE}""")
def search_threads(spark, sf_dir):
    found = submissions.search_threads(views.submissions(spark, sf_dir), "Discussion POST", _SINCE)
    return submissions.flatten(found, NOW).threads


@query(sql("lines", f"""
    SELECT m.*, t.* EXCLUDE ("PostID", permalink, "createdDate", "AuthorID", "AuthorName", score, "insertionTimestamp") FROM
        ({_MESSAGE_SQL} AND doc_id = 42) m JOIN ({_THREAD_SQL} WHERE doc_id = 42) t USING ("PostID")"""))
def thread_by_key(spark, sf_dir):
    one = submissions.thread_by_url(views.submissions(spark, sf_dir), "http://example.com/42", NOW)
    shared = [c for c in one.threads.columns if c in one.messages.columns and c != "PostID"]
    return one.messages.join(one.threads.drop(*shared), "PostID")


@query("""
    WITH loads AS (
        SELECT event_id AS key, value, 1 AS load_no FROM events
        UNION ALL SELECT event_id * 2, value + 1000, 2 FROM events
        UNION ALL SELECT event_id * 3, value + 2000, 3 FROM events)
    SELECT key, arg_max(value, load_no) AS value, max(load_no) AS load_no FROM loads GROUP BY key""")
def upsert_latest(spark, sf_dir):
    def load(number: int) -> DataFrame:
        return views.table(spark, sf_dir, "events").select(
            (F.col("event_id") * number).alias("key"),
            (F.col("value") + (number - 1) * 1000).alias("value"),
            F.lit(number).alias("load_no"),
        )

    return store.upsert_latest(load(1), load(2).unionByName(load(3)), "key", "load_no")


@query("""
    SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events
    WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 12:00:00'""")
def messages_between(spark, sf_dir):
    after, before = (
        F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-25 12:00:00")
    )
    events = calendar.after_and_before(views.table(spark, sf_dir, "events"), "ts", after, before)
    return events.withColumn("ts", _text_time("ts"))


@query(sql("messages threads", """
    SELECT * FROM messages
    WHERE thread_id IN (SELECT thread_id FROM threads WHERE title LIKE '%Daily Discussion%')"""))
def messages_for_threads(spark, sf_dir):
    wanted = views.threads(spark, sf_dir).where(labels.thread_type(F.col("title")) == "MID")
    return store.messages_of(views.messages(spark, sf_dir), wanted)


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events")
def high_water_mark(spark, sf_dir):
    mark = store.high_water_mark(views.table(spark, sf_dir, "events"), "ts")
    return mark.select(_text_time("latest").alias("latest"))


_TURNS = TableSpec("Turn", "turn_id", (ColumnSpec("turn_id", None, "string"), ColumnSpec("text", None, "string")))


@query("""
    SELECT CASE WHEN role <> 'system' THEN conv_id || '-' || turn END AS turn_id, conv_id, turn, role, text,
           CASE WHEN role = 'system' THEN 'turn_id is null' END AS reason
    FROM conversations""")
def load_quality(spark, sf_dir):
    turn_id = F.when(F.col("role") != "system", F.concat_ws("-", "conv_id", "turn"))
    turns = views.table(spark, sf_dir, "conversations").select(turn_id.alias("turn_id"), "conv_id", "turn", "role", "text")
    return turns.withColumn("reason", quality.rejection(_TURNS, turns.columns))


def _exported(frame: DataFrame) -> str:
    """The frame as delimited files in the session's shared folder; their path."""
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    files.write_csv(frame, path)
    return path


def _message_export(spark: SparkSession, sf_dir: str) -> str:
    none = F.lit(None).cast("string")
    return _exported(views.messages(spark, sf_dir).select(
        F.col("message_id").alias("CommentID"), F.col("thread_id").alias("PostID"), "permalink", none.alias("AuthorID"),
        F.col("author").alias("AuthorName"), F.col("created_epoch").alias("createdDate"), "body", "score",
        none.alias("parentID"), F.col("inserted_epoch").alias("insertionTimestamp"), "compound",
    ))


def _thread_export(spark: SparkSession, sf_dir: str) -> str:
    return _exported(submissions.flatten_threads(views.submissions(spark, sf_dir), NOW).drop("isPoll"))


def _roster_export(spark: SparkSession, sf_dir: str) -> str:
    stints = roster.clean_roster(views.raw_roster(spark, sf_dir))
    return _exported(stints.select(
        F.col("entity").alias("Islander"), F.col("age").alias("Age"), F.col("hometown").alias("Hometown"),
        F.col("entry_day").alias("ShowEntryDay"), F.col("leave_day").alias("ShowLeaveDay"),
        F.col("leave_status").alias("OnLeaveStatus"), F.col("main_entry_day").alias("MainVillaEntryDay"),
    ))


def _timeline_export(spark: SparkSession, sf_dir: str) -> str:
    """Events whose hour is 23 have a day that is not a number."""
    unreadable = F.col("summary").endswith(" at 23")
    return _exported(views.timeline(spark, sf_dir).select(
        F.when(unreadable, F.lit("unknown")).otherwise(F.col("day").cast("string")).alias("Day"),
        F.col("type").alias("Type"), F.col("summary").alias("Summary"), F.col("entity").alias("Islanders"),
    ))


@query(sql("messages", f"""
    SELECT CAST(message_id AS VARCHAR) AS message_id, CAST(thread_id AS VARCHAR) AS thread_id, created_epoch, day, body,
           author, score, compound, permalink, inserted_epoch, {_time_sql('created_epoch')} AS created
    FROM messages"""))
def load_messages_csv(spark, sf_dir):
    loaded = files.load_messages(spark, _message_export(spark, sf_dir), ORIGIN)
    return loaded.withColumn("created", _text_time("date")).drop("date", "author_id", "parent_id")


@query(f"""
    SELECT * EXCLUDE ("isPoll"), CASE WHEN title LIKE '%Daily Discussion%' THEN 'MID'
                                      WHEN lower(title) LIKE '%post%' THEN 'POST' ELSE 'PRE' END AS type
    FROM ({_THREAD_SQL})""")
def load_threads_csv(spark, sf_dir):
    return files.load_threads(spark, _thread_export(spark, sf_dir))


@query(sql("raw_roster clean_roster", """
    SELECT entity, age, hometown, entry_day, leave_day, leave_status, main_entry_day FROM clean_roster"""))
def load_roster_csv(spark, sf_dir):
    return files.load_roster(spark, _roster_export(spark, sf_dir))


@query(sql("timeline", "SELECT day, type, summary, entity FROM timeline WHERE summary NOT LIKE '% at 23'"))
def load_timeline_csv(spark, sf_dir):
    return files.load_timeline(spark, _timeline_export(spark, sf_dir))


@query(sql("raw_roster clean_roster dictionary timeline", """
    SELECT 'messages' AS table_name, count(*) AS n FROM documents
    UNION ALL SELECT 'threads', count(*) FROM documents
    UNION ALL SELECT 'roster', count(*) FROM clean_roster
    UNION ALL SELECT 'timeline', count(*) FROM timeline WHERE summary NOT LIKE '% at 23'
    UNION ALL SELECT 'aliases', count(*) FROM dictionary
    UNION ALL SELECT 'rejected timeline', count(*) FROM timeline WHERE summary LIKE '% at 23' HAVING count(*) > 0"""))
def load_bundle(spark, sf_dir):
    wide = views.wide_aliases(spark, sf_dir)
    raw = files.load_raw(
        spark, _message_export(spark, sf_dir), _thread_export(spark, sf_dir), _roster_export(spark, sf_dir),
        _timeline_export(spark, sf_dir), _exported(wide.drop("row_no").withColumn("alias_4", F.lit(None).cast("string"))), ORIGIN,
    )
    tables = {"messages": raw.messages, "threads": raw.threads, "roster": raw.roster, "timeline": raw.timeline, "aliases": raw.aliases}
    counts = raw.rejected.groupBy(F.concat(F.lit("rejected "), "table_name").alias("table_name")).agg(F.count("*").alias("n"))
    for name, frame in tables.items():
        counts = counts.unionByName(frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return counts


def _archive(spark: SparkSession, sf_dir: str) -> store.ArchiveStore:
    """A new archive after two pulls, the second of the threads since a date, with a later insertion."""
    archive = store.ArchiveStore(spark, f"archive_{uuid.uuid4().hex}")
    archive.create_all()
    nested = views.submissions(spark, sf_dir)
    for pulled, now in ((nested, NOW), (submissions.created_since(nested, _SINCE), NOW + 60)):
        archive.replace_into(THREADS, submissions.flatten_threads(pulled, now))
        archive.replace_into(MESSAGES, submissions.flatten_messages(pulled, now))
    return archive


_LATER = f'CAST({NOW} + CASE WHEN "createdDate" >= {_SINCE} THEN 60 ELSE 0 END AS BIGINT) AS "insertionTimestamp"'


@query(f"SELECT * REPLACE ({_LATER}) FROM ({_THREAD_SQL})")
def archive_scan(spark, sf_dir):
    return _archive(spark, sf_dir).scan(THREADS)


@query("SELECT 't-' || doc_id AS \"PostID\" FROM documents")
def archive_thread_ids(spark, sf_dir):
    return _archive(spark, sf_dir).thread_ids()


@query(sql("lines", f"""
    SELECT * EXCLUDE (thread_created)
             REPLACE (CAST({NOW} + CASE WHEN thread_created >= {_SINCE} THEN 60 ELSE 0 END AS BIGINT) AS "insertionTimestamp")
    FROM ({_MESSAGE_SQL.replace('created + i AS "createdDate"', 'created AS thread_created, created + i AS "createdDate"')})
    WHERE "createdDate" > {_SINCE - 86_400} AND "createdDate" < {_SINCE + 3 * 86_400}"""))
def archive_between(spark, sf_dir):
    return _archive(spark, sf_dir).created_between(MESSAGES, _SINCE - 86_400, _SINCE + 3 * 86_400)


@query(sql("messages aliases mentions", """
    SELECT day, entity, CAST(sum(n) AS BIGINT) AS n FROM mentions WHERE day BETWEEN 3 AND 26 GROUP BY day, entity"""))
def stored_series(spark, sf_dir):
    tables = store.Materialised(spark, f"analytics_{uuid.uuid4().hex}")
    held = stored.StoredAnalytics(tables, views.messages(spark, sf_dir), views.book())
    held.mention_sets()
    return daily.daily_mentions(calendar.within_days(held.mention_rows(), 3, 26))


# ---------------------------------------------------------------- derivations and roster


@query(sql("threads", """
    SELECT thread_id, CASE WHEN title LIKE '%Daily Discussion%' THEN 'MID'
                           WHEN lower(title) LIKE '%post%' THEN 'POST' ELSE 'PRE' END AS type FROM threads"""))
def thread_type(spark, sf_dir):
    return views.threads(spark, sf_dir).select(
        "thread_id", labels.thread_type(F.col("title")).alias("type")
    )


_DAY_SQL = f"CAST(floor((createdDate - {ORIGIN}) / 86400) + 1 AS INTEGER)"


@query(sql("threads", f"""
    SELECT {_DAY_SQL} AS "Day",
           CASE WHEN title LIKE '%Daily Discussion%' THEN 'MID' WHEN lower(title) LIKE '%post%' THEN 'POST'
                ELSE 'PRE' END AS "Type of Discussion Thread",
           {_time_sql('createdDate')} AS "Date", title AS "Title", selfText AS "Text", score AS "Score",
           AuthorName AS "Author's username", permalink AS "Permalink",
           {_time_sql('insertionTimestamp')} AS "Date Inserted (to db)"
    FROM threads"""))
def thread_table(spark, sf_dir):
    typed = views.threads(spark, sf_dir).withColumn("type", labels.thread_type(F.col("title")))
    shown = files.thread_table(typed, ORIGIN)
    return shown.withColumns({c: _text_time(f"`{c}`") for c in ("Date", "Date Inserted (to db)")})


@query(sql("messages", f"""
    SELECT day AS "Day", {_time_sql('created_epoch')} AS "Date", body AS "Text", score AS "Score",
           compound AS "Sentiment Score", author AS "Author's username", permalink AS "Permalink",
           {_time_sql('inserted_epoch')} AS "Date Inserted (to db)"
    FROM messages WHERE day BETWEEN 3 AND 26"""))
def message_table(spark, sf_dir):
    shown = files.message_table(calendar.within_days(views.messages(spark, sf_dir), 3, 26))
    return shown.withColumns({c: _text_time(f"`{c}`") for c in ("Date", "Date Inserted (to db)")})


@query(sql("messages", f"""
    SELECT CAST(floor((max(created_epoch) - {ORIGIN}) / 86400) + 1 AS INTEGER) AS last_day FROM messages"""))
def season_length(spark, sf_dir):
    return files.season_length(views.messages(spark, sf_dir), ORIGIN)


@query(sql("raw_roster clean_roster", """
    SELECT entity, entry_day, leave_day, main_entry_day, leave_status,
           entry_day IS DISTINCT FROM main_entry_day AS late_arrival, entry_day = 1 AS original,
           entry_day <> 1 AS bombshell, leave_status IS DISTINCT FROM 'Dumped' AS finalist,
           leave_day IS NULL AS still_in
    FROM clean_roster"""))
def entity_cohorts(spark, sf_dir):
    stints = roster.clean_roster(views.raw_roster(spark, sf_dir))
    return roster.with_cohorts(stints).drop("age", "hometown")


@query(sql("raw_roster clean_roster", """
    SELECT DISTINCT entity FROM clean_roster WHERE entry_day = 1 OR leave_status IS DISTINCT FROM 'Dumped'"""))
def picked_entities(spark, sf_dir):
    stints = roster.load_and_clean(views.raw_roster(spark, sf_dir))
    return roster.pick_entities(stints, ["original", "finalist"])


@query(sql("raw_roster dictionary", """
    , names AS (SELECT string_split(name, ' ')[1] AS alias, arg_max(name, row_no) AS entity
                FROM raw_roster WHERE name IS NOT NULL GROUP BY 1)
    SELECT alias, entity FROM dictionary
    UNION ALL SELECT alias, entity FROM names WHERE alias NOT IN (SELECT alias FROM dictionary)"""))
def search_dictionary(spark, sf_dir):
    names = views.raw_roster(spark, sf_dir).where("Islander IS NOT NULL")
    built = aliases.alias_dictionary(
        views.wide_aliases(spark, sf_dir), "entity", ["alias_1", "alias_2", "alias_3"], "row_no"
    )
    return aliases.search_dictionary(names, "Islander", "row_no", built)


@query(sql("raw_roster clean_roster", """
    SELECT entity, age, hometown, entry_day, leave_day, leave_status, main_entry_day FROM clean_roster"""))
def roster_clean(spark, sf_dir):
    return roster.clean_roster(views.raw_roster(spark, sf_dir))


@query(sql("messages", """
    SELECT message_id, CAST(CASE WHEN compound >= 0.05 THEN 1 WHEN compound <= -0.05 THEN -1 ELSE 0 END
           AS INTEGER) AS label FROM messages"""))
def sentiment_label(spark, sf_dir):
    return views.messages(spark, sf_dir).select(
        "message_id", labels.sentiment_label(F.col("compound"), -0.05, 0.05).alias("label")
    )


# ---------------------------------------------------------------- text


@query(sql("aliases messages mentions", "SELECT message_id, day, entity, n FROM mentions"))
def mention_counts(spark, sf_dir):
    return mentions.mention_rows(_scan(spark, sf_dir)).drop("lead")


_OUTER = "|".join("(" + "|".join(names) + ")" for names in views.ALIASES.values())


@query(sql("aliases messages", rf""", hits AS (
        SELECT message_id, day, unnest(regexp_extract_all(body, '\b{_OUTER}\b')) AS alias FROM messages)
    SELECT message_id, day, entity, count(*) AS n FROM hits JOIN aliases USING (alias)
    GROUP BY message_id, day, entity"""))
def mention_counts_outer(spark, sf_dir):
    return mentions.mention_rows(_scan(spark, sf_dir, "outer")).drop("lead")


@query(sql("aliases messages", r""", tokens AS (
        SELECT message_id, day, unnest(regexp_extract_all(
            regexp_replace(body, '[^\p{L}\p{N}_\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]', '', 'g'),
            '[^\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]+')) AS alias
        FROM messages),
    hits AS (SELECT message_id, day, entity, count(*) AS n FROM tokens JOIN aliases USING (alias)
             GROUP BY message_id, day, entity)
    SELECT message_id, day, entity, n FROM hits
    UNION ALL SELECT DISTINCT message_id, day, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM tokens
    WHERE message_id NOT IN (SELECT message_id FROM hits)"""))
def mention_counts_tokens(spark, sf_dir):
    return mentions.count_whole_tokens(views.messages(spark, sf_dir), views.book())


@query(sql("word_aliases messages", r""", tokens AS (
        SELECT message_id, day, unnest(regexp_extract_all(
            regexp_replace(body, '[^\p{L}\p{N}_\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]', '', 'g'),
            '[^\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]+')) AS alias
        FROM messages),
    hits AS (SELECT message_id, day, entity, count(*) AS n FROM tokens JOIN word_aliases USING (alias)
             GROUP BY message_id, day, entity)
    SELECT message_id, day, entity, n FROM hits
    UNION ALL SELECT DISTINCT message_id, day, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM tokens
    WHERE message_id NOT IN (SELECT message_id FROM hits)"""))
def mention_counts_tokens_large(spark, sf_dir):
    return mentions.count_whole_tokens(views.messages(spark, sf_dir), views.word_aliases(spark, sf_dir))


@query(sql("word_aliases messages", r""", tokens AS (
        SELECT message_id, day, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS alias FROM messages)
    SELECT message_id, day, entity, count(*) AS n FROM tokens JOIN word_aliases USING (alias)
    GROUP BY message_id, day, entity"""))
def mention_counts_large(spark, sf_dir):
    found = mentions.scan_mentions(views.messages(spark, sf_dir), views.word_aliases(spark, sf_dir))
    return mentions.mention_rows(found).drop("lead")


@query(sql("raw_roster clean_roster", "SELECT DISTINCT entity FROM clean_roster"))
def distinct_entities(spark, sf_dir):
    return roster.all_entities(roster.clean_roster(views.raw_roster(spark, sf_dir)))


@query(sql("dictionary", """
    SELECT entity, array_to_string(list(alias ORDER BY place, alias), '|') AS aliases FROM dictionary GROUP BY entity"""))
def alias_lists(spark, sf_dir):
    built = aliases.alias_dictionary(
        views.wide_aliases(spark, sf_dir), "entity", ["alias_1", "alias_2", "alias_3"], "row_no"
    )
    return aliases.alias_lists(built).select("entity", F.array_join("aliases", "|").alias("aliases"))


def _push_sql() -> str:
    terms = []
    for distance, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
        for word, strength in views.BOOSTERS.items():
            terms.append(
                f"CASE WHEN coalesce(before_{distance}, '') = '{word}' "
                f"THEN CAST({strength * damping!r} AS DOUBLE) ELSE 0 END"
            )
    return " + ".join(terms)


_NEGATION_SQL = "(" + ", ".join(f"'{w}'" for w in views.NEGATIONS) + ")"


@query(rf"""
    WITH lexicon AS (
        SELECT DISTINCT token, CAST(length(token) * 7 % 9 - 4 AS DOUBLE) AS valence
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS token FROM benchmark)),
    lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') AS list FROM documents),
    tokens AS (SELECT doc_id, unnest(list) AS token, unnest(range(len(list))) AS i FROM lists),
    placed AS (
        SELECT doc_id, token, lag(token, 1) OVER w AS before_1, lag(token, 2) OVER w AS before_2,
               lag(token, 3) OVER w AS before_3
        FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    boosted AS (
        SELECT doc_id, coalesce(valence, 0) AS valence,
               valence + CASE WHEN valence < 0 THEN -1 ELSE 1 END * ({_push_sql()}) AS strong,
               coalesce(before_1, '') IN {_NEGATION_SQL} OR coalesce(before_2, '') IN {_NEGATION_SQL}
                   OR coalesce(before_3, '') IN {_NEGATION_SQL} AS negated
        FROM placed LEFT JOIN lexicon USING (token)),
    scored AS (
        SELECT doc_id, CASE WHEN valence = 0 THEN 0 WHEN negated THEN strong * CAST(-0.74 AS DOUBLE)
                            ELSE strong END AS s
        FROM boosted),
    sums AS (
        SELECT d.doc_id, coalesce(sum(s), 0) AS total, coalesce(sum(s + 1) FILTER (s > 0), 0) AS up,
               coalesce(sum(1 - s) FILTER (s < 0), 0) AS down, count(*) FILTER (s = 0) AS flat
        FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id)
    SELECT doc_id AS message_id, round(coalesce(down / nullif(up + down + flat, 0), 0), 4) AS neg,
           round(coalesce(flat / nullif(up + down + flat, 0), 0), 4) AS neu,
           round(coalesce(up / nullif(up + down + flat, 0), 0), 4) AS pos,
           round(total / sqrt(total * total + 15), 4) AS compound
    FROM sums""")
def lexicon_sentiment(spark, sf_dir):
    scores = sentiment.lexicon_sentiment(
        views.messages(spark, sf_dir), views.lexicon(spark, sf_dir), views.NEGATIONS, views.BOOSTERS
    )
    return scores.withColumns({c: F.round(c, 4) for c in ("neg", "neu", "pos", "compound")})


@query(sql("raw_roster clean_roster", """
    , firsts AS (SELECT entity, arg_min(entry_day, (entry_day, row_no)) AS entry_day FROM clean_roster GROUP BY entity)
    SELECT entity, row_number() OVER (ORDER BY entry_day, entity) - 1 AS code FROM firsts"""))
def entity_codes(spark, sf_dir):
    return codes.entity_codes(roster.clean_roster(views.raw_roster(spark, sf_dir)))


@query(sql("aliases messages mentions edges totals roster", """
    , firsts AS (SELECT entity, min(entry_day) AS entry_day FROM roster GROUP BY entity),
    codes AS (SELECT entity, row_number() OVER (ORDER BY entry_day, entity) - 1 AS code FROM firsts)
    SELECT x, y, weight, '(' || a.code || ', ' || b.code || ')' AS pair, x AS x_again, y AS y_again
    FROM totals JOIN codes a ON a.entity = x JOIN codes b ON b.entity = y"""))
def pair_encode_roundtrip(spark, sf_dir):
    coded_entities = codes.entity_codes(views.roster(spark))
    totals = _totals(spark, sf_dir)
    originals = totals.select(F.struct("x", "y").alias("original"), "x", "y", "weight")
    coded = codes.encode_pairs(originals, coded_entities).withColumn("text", F.col("pair"))
    back = codes.decode_pairs(coded, coded_entities)
    return back.select(
        "original.x",
        "original.y",
        "weight",
        F.col("text").alias("pair"),
        F.col("x").alias("x_again"),
        F.col("y").alias("y_again"),
    )


# ---------------------------------------------------------------- daily analytics


@query(sql("aliases messages mentions daily", "SELECT day, entity, n FROM daily"))
def daily_mentions(spark, sf_dir):
    return _daily(spark, sf_dir)


_STATS = "entities aliases messages mentions daily days dense"


@query(sql(_STATS, """
    SELECT day, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM dense GROUP BY day"""))
def daily_mention_stats(spark, sf_dir):
    stats = daily.daily_spread(_daily(spark, sf_dir), POPULATION, FIRST, LAST)
    return stats.withColumns(_round("mean", "std"))


@query(sql(_STATS + " picked", """
    SELECT day, entity, CAST(n AS DOUBLE) AS value FROM dense WHERE entity IN (SELECT entity FROM picked)
    UNION ALL SELECT day, 'Average', round(avg(n), 6) FROM dense GROUP BY day"""))
def daily_mentions_with_average(spark, sf_dir):
    series = daily.dense_series(
        _daily(spark, sf_dir), views.picked(spark), FIRST, LAST, population=POPULATION
    )
    return series.withColumns(_round("value"))


@query(sql("picked aliases messages mentions daily", """
    SELECT entity, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
    FROM picked LEFT JOIN (SELECT * FROM daily WHERE day BETWEEN 3 AND 26) USING (entity) GROUP BY entity"""))
def total_mentions(spark, sf_dir):
    return daily.entity_totals(_daily(spark, sf_dir), views.picked(spark), 3, 26)


@query(sql(_STATS + " picked", """
    SELECT day, entity, n AS value FROM dense
    WHERE entity IN (SELECT entity FROM picked) AND day BETWEEN 3 AND 26"""))
def daily_series_long(spark, sf_dir):
    return daily.dense_series(_daily(spark, sf_dir), views.picked(spark), 3, 26)


@query(sql(_STATS, """
    SELECT day, round(avg(n), 6) AS mean, round(avg(n) - 2 * stddev_samp(n), 6) AS lower,
           round(avg(n) + 2 * stddev_samp(n), 6) AS upper
    FROM dense GROUP BY day"""))
def mention_band(spark, sf_dir):
    stats = daily.daily_spread(_daily(spark, sf_dir), POPULATION, FIRST, LAST)
    return daily.band(stats).drop("std").withColumns(_round("mean", "lower", "upper"))


_SENTIMENT = "entities aliases messages mentions daily days daily_sentiment dense_sentiment"


@query(sql(_SENTIMENT, "SELECT day, entity, round(sentiment, 6) AS value FROM dense_sentiment"))
def daily_sentiment(spark, sf_dir):
    dense = daily.dense_grid(
        _sentiment(spark, sf_dir), views.entities(spark), FIRST, LAST, value="sentiment"
    )
    return dense.withColumns(_round("value"))


@query(sql("entities aliases messages mentions", """
    , counts AS (SELECT day, count(DISTINCT message_id) AS messages FROM mentions GROUP BY day),
    sums AS (SELECT day, entity, sum(compound) AS total FROM mentions GROUP BY day, entity)
    SELECT c.day, e.entity, round(coalesce(total, 0) / messages, 6) AS value
    FROM counts c CROSS JOIN entities e LEFT JOIN sums s ON s.day = c.day AND s.entity = e.entity"""))
def daily_sentiment_zerofill(spark, sf_dir):
    series = _sentiment(spark, sf_dir, "zerofill")
    dense = daily.dense_grid(series, views.entities(spark), FIRST, LAST, value="sentiment")
    return dense.withColumns(_round("value"))


@query(sql(_SENTIMENT, """
    SELECT day, round(avg(sentiment), 6) AS mean, round(stddev_samp(sentiment), 6) AS std
    FROM dense_sentiment GROUP BY day"""))
def daily_sentiment_stats(spark, sf_dir):
    stats = daily.daily_spread(_sentiment(spark, sf_dir), POPULATION, FIRST, LAST, value="sentiment")
    return stats.withColumns(_round("mean", "std"))


@query(sql(_SENTIMENT + " picked", """
    SELECT day, entity, round(sentiment, 6) AS value FROM dense_sentiment
    WHERE entity IN (SELECT entity FROM picked)
    UNION ALL SELECT day, 'Average', round(avg(sentiment), 6) FROM dense_sentiment GROUP BY day"""))
def daily_sentiment_with_average(spark, sf_dir):
    series = daily.dense_series(
        _sentiment(spark, sf_dir), views.picked(spark), FIRST, LAST, "sentiment", POPULATION
    )
    return series.withColumns(_round("value"))


@query(sql(_SENTIMENT + " picked", """
    SELECT entity, round(avg(sentiment), 6) AS sentiment FROM dense_sentiment
    WHERE entity IN (SELECT entity FROM picked) AND day BETWEEN 3 AND 26 GROUP BY entity"""))
def mean_sentiment(spark, sf_dir):
    means = sentiment.mean_sentiment(_sentiment(spark, sf_dir), views.picked(spark), 3, 26)
    return means.withColumns(_round("sentiment"))


@query(sql(_STATS + " picked", """
    SELECT day, CAST(sum(n) AS BIGINT) AS value FROM dense
    WHERE entity IN (SELECT entity FROM picked) GROUP BY day"""))
def day_totals(spark, sf_dir):
    return daily.day_totals(_daily(spark, sf_dir), views.picked(spark), FIRST, LAST).orderBy("value", "day")


@query(sql(_SENTIMENT + " picked", """
    SELECT day, round(avg(sentiment), 6) AS value FROM dense_sentiment
    WHERE entity IN (SELECT entity FROM picked) GROUP BY day"""))
def day_mean_sentiment(spark, sf_dir):
    means = sentiment.day_mean_sentiment(_sentiment(spark, sf_dir), views.picked(spark), FIRST, LAST)
    return means.orderBy("value", "day").withColumns(_round("value"))


# ---------------------------------------------------------------- timeline and moments


@query(sql("timeline", "SELECT DISTINCT type, day FROM timeline"))
def event_type_days(spark, sf_dir):
    return timeline.event_type_days(views.timeline(spark, sf_dir))


@query(sql("timeline picked", """
    , folded AS (
        SELECT type, summary, day, entity, count(*) AS n FROM timeline
        WHERE entity IN (SELECT entity FROM picked) AND day BETWEEN 3 AND 26
        GROUP BY type, summary, day, entity)
    SELECT type, summary, day, array_to_string(list(entity ORDER BY entity), '|') AS entities,
           array_to_string(list(n ORDER BY entity), '|') AS rows
    FROM folded GROUP BY type, summary, day"""))
def event_entities(spark, sf_dir):
    grouped = timeline.event_entities(views.timeline(spark, sf_dir), views.picked(spark), 3, 26)
    return grouped.withColumns(
        {"entities": F.array_join("entities", "|"), "rows": F.array_join(F.col("rows").cast("array<string>"), "|")}
    )


@query(sql("timeline", """
    SELECT type, day, summary, count(*) AS n FROM timeline
    WHERE type IN ('signup', 'error') AND day BETWEEN 3 AND 26 GROUP BY type, day, summary"""))
def event_markers(spark, sf_dir):
    return timeline.event_markers(views.timeline(spark, sf_dir), ["signup", "error"], 3, 26)


@query(sql("timeline", """
    , spine AS (SELECT CAST(unnest(range(1, 36)) AS INTEGER) AS day),
    types AS (SELECT day, string_agg(type, ', ' ORDER BY type) AS types
              FROM (SELECT DISTINCT day, type FROM timeline) GROUP BY day),
    texts AS (SELECT day, string_agg(summary, chr(10) ORDER BY summary) AS summaries
              FROM (SELECT DISTINCT day, summary FROM timeline) GROUP BY day)
    SELECT day, types, summaries FROM spine LEFT JOIN types USING (day) LEFT JOIN texts USING (day)"""))
def day_digest(spark, sf_dir):
    return timeline.day_digest(views.timeline(spark, sf_dir), 1, 35)


@query(sql("timeline", """
    , spine AS (SELECT CAST(unnest(range(1, 36)) AS INTEGER) AS day)
    SELECT DISTINCT day, type, summary FROM spine LEFT JOIN timeline USING (day)"""))
def day_digest_rows(spark, sf_dir):
    return timeline.day_digest_rows(views.timeline(spark, sf_dir), 1, 35)


@query(sql(_STATS + " picked timeline", """
    , values AS (SELECT day, CAST(sum(n) AS BIGINT) AS value FROM dense
                 WHERE entity IN (SELECT entity FROM picked) GROUP BY day),
    grouped AS (SELECT type, summary, day, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities
                FROM timeline GROUP BY type, summary, day)
    SELECT v.day, v.value, g.type, g.summary, g.entities FROM values v LEFT JOIN grouped g USING (day)"""))
def day_events(spark, sf_dir):
    days = daily.day_totals(_daily(spark, sf_dir), views.picked(spark), FIRST, LAST)
    joined = timeline.day_events(days, views.timeline(spark, sf_dir))
    return joined.select("day", "value", "type", "summary", F.array_join("entities", "|").alias("entities"))


_MENTION_BLOCKS = """
    , day_values AS (SELECT day, sum(n) AS value FROM dense
                     WHERE entity IN (SELECT entity FROM picked) GROUP BY day),
    placed AS (SELECT day, value, (row_number() OVER (ORDER BY day) - 1) // 3 AS block FROM day_values),
    blocks AS (SELECT CAST(block AS INTEGER) AS block, list(day ORDER BY day) AS days,
                      CAST(sum(value) AS DOUBLE) AS value FROM placed GROUP BY block)"""
_SENTIMENT_BLOCKS = """
    , day_values AS (SELECT day, avg(sentiment) AS value FROM dense_sentiment
                     WHERE entity IN (SELECT entity FROM picked) GROUP BY day),
    bounds AS (SELECT min(day) AS low, max(day) AS high, count(*) // 3 AS bins FROM day_values),
    placed AS (SELECT day, value, greatest(((day - low) * bins + high - low - 1) // (high - low) - 1, 0) AS block
               FROM day_values, bounds),
    blocks AS (SELECT CAST(block AS INTEGER) AS block, list(day ORDER BY day) AS days, avg(value) AS value
               FROM placed GROUP BY block)"""
_EXTREMES = """
    , ranked AS (SELECT days, value, row_number() OVER (ORDER BY value DESC, days[1]) AS top,
                        row_number() OVER (ORDER BY value, days[1]) AS bottom, count(*) OVER () AS n FROM blocks),
    moments AS (SELECT 'high' AS side, CAST(top AS INTEGER) AS rank, days, value FROM ranked WHERE top <= 3 AND n >= 3
                UNION ALL SELECT 'low', CAST(bottom AS INTEGER), days, value FROM ranked WHERE bottom <= 3 AND n >= 3)"""
_SHOW_BLOCKS = "SELECT block, array_to_string(days, ',') AS days, round(value, 6) AS value FROM blocks"
_SHOW_MOMENTS = "SELECT side, rank, array_to_string(days, ',') AS days, round(value, 6) AS value FROM moments"


def _joined_days() -> dict[str, Column]:
    return {"days": F.array_join(F.col("days").cast("array<string>"), ","), "value": F.round("value", 6)}


def _mention_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = daily.day_totals(_daily(spark, sf_dir), views.picked(spark), FIRST, LAST)
    return moments.ordinal_blocks(values, 3)


def _sentiment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = sentiment.day_mean_sentiment(_sentiment(spark, sf_dir), views.picked(spark), FIRST, LAST)
    return moments.equal_width_blocks(values, 3)


@query(sql(_STATS + " picked", _MENTION_BLOCKS + _SHOW_BLOCKS))
def moment_blocks(spark, sf_dir):
    return _mention_blocks(spark, sf_dir).withColumns(_joined_days())


@query(sql(_SENTIMENT + " picked", _SENTIMENT_BLOCKS + _SHOW_BLOCKS))
def sentiment_blocks(spark, sf_dir):
    return _sentiment_blocks(spark, sf_dir).withColumns(_joined_days())


@query(sql(_STATS + " picked", _MENTION_BLOCKS + _EXTREMES + _SHOW_MOMENTS))
def top_moments(spark, sf_dir):
    return moments.extremes(_mention_blocks(spark, sf_dir)).withColumns(_joined_days())


@query(sql(_SENTIMENT + " picked", _SENTIMENT_BLOCKS + _EXTREMES + _SHOW_MOMENTS))
def moments_sentiment(spark, sf_dir):
    return moments.extremes(_sentiment_blocks(spark, sf_dir)).withColumns(_joined_days())


@query(sql(_STATS + " picked timeline", _MENTION_BLOCKS + _EXTREMES + """
    , placed_days AS (SELECT side, rank, unnest(days) AS day FROM moments),
    facts AS (
        SELECT side, rank, string_agg(DISTINCT type, ', ' ORDER BY type) AS types,
               '* ' || string_agg(DISTINCT summary, chr(10) || '* ' ORDER BY summary) AS summaries,
               string_agg(DISTINCT entity, ', ' ORDER BY entity) AS entities
        FROM placed_days JOIN timeline USING (day) GROUP BY side, rank)
    SELECT side, rank, CASE WHEN len(days) = 1 THEN 'Day ' || days[1]
                            ELSE 'Days ' || list_min(days) || ' to ' || list_max(days) END AS day_range,
           round(value, 2) AS value, coalesce(types, '') AS types,
           coalesce(summaries, 'No main events happened') AS summaries, coalesce(entities, '') AS entities
    FROM moments LEFT JOIN facts USING (side, rank)"""))
def moment_details(spark, sf_dir):
    found = moments.extremes(_mention_blocks(spark, sf_dir))
    details = moments.moment_details(found, views.timeline(spark, sf_dir))
    return details.withColumns({c: F.array_join(c, ", ") for c in ("types", "entities")})


@query(sql(_STATS + " picked timeline", _MENTION_BLOCKS + _EXTREMES + """
    , placed_days AS (SELECT side, rank, unnest(days) AS day FROM moments)
    SELECT DISTINCT side, rank, day, type, summary, entity FROM placed_days JOIN timeline USING (day)"""))
def moment_records(spark, sf_dir):
    return moments.moment_records(moments.extremes(_mention_blocks(spark, sf_dir)), views.timeline(spark, sf_dir))


# The function's module of the same name is in use above, so this key is set by hand.
for _registry in (QUERIES, ORACLES):
    _registry["moments"] = _registry.pop("top_moments")

# ---------------------------------------------------------------- after an exit

_POST_EXIT = _STATS + " roster exits picked"
_OFFSETS = """
    , offsets AS (SELECT entity, day - leave_day AS "offset", n FROM dense JOIN exits USING (entity))"""


@query(sql(_POST_EXIT, _OFFSETS + """
    SELECT entity, "offset", n AS value FROM offsets
    WHERE "offset" BETWEEN 1 AND 7 AND entity IN (SELECT entity FROM picked)"""))
def post_exit_daily(spark, sf_dir):
    exits = roster.last_exits(views.roster(spark))
    return postexit.post_exit_daily(_daily(spark, sf_dir), exits, views.picked(spark), FIRST, LAST)


@query(sql(_POST_EXIT, _OFFSETS + """
    SELECT "offset", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM offsets GROUP BY "offset" """))
def post_exit_stats(spark, sf_dir):
    exits = roster.last_exits(views.roster(spark))
    stats = postexit.post_exit_spread(
        _daily(spark, sf_dir), exits, views.entities(spark), FIRST, LAST, max_offset=None
    )
    return stats.withColumns(_round("mean", "std"))


@query(sql(_POST_EXIT, _OFFSETS + """
    SELECT entity, "offset", CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS std FROM offsets
    WHERE "offset" BETWEEN 1 AND 7 AND entity IN (SELECT entity FROM picked)
    UNION ALL SELECT 'Average', "offset", round(avg(n), 6), round(stddev_samp(n), 6) FROM offsets
    WHERE "offset" BETWEEN 1 AND 7 GROUP BY "offset" """))
def post_exit_with_average(spark, sf_dir):
    exits = roster.last_exits(views.roster(spark))
    series = postexit.post_exit_with_average(
        _daily(spark, sf_dir), exits, views.picked(spark), views.entities(spark), FIRST, LAST
    )
    return series.withColumns(_round("value", "std"))


@query(sql(_POST_EXIT, _OFFSETS + """
    SELECT entity, CAST(sum(n) AS BIGINT) AS total FROM offsets
    WHERE "offset" BETWEEN 1 AND 7 AND entity IN (SELECT entity FROM picked) GROUP BY entity"""))
def post_exit_totals(spark, sf_dir):
    return postexit.post_exit_totals(post_exit_daily(spark, sf_dir))


# ---------------------------------------------------------------- co-mentions


@query(sql("aliases messages mentions", """
    SELECT message_id, day, string_agg(entity, '|' ORDER BY n DESC, entity) AS entities
    FROM mentions GROUP BY message_id, day"""))
def mentioned_lists(spark, sf_dir):
    listed = mentions.mentioned_lists(_sets(spark, sf_dir))
    return listed.withColumn("entities", F.array_join("entities", "|"))


_EDGES = "aliases messages mentions edges totals"


@query(sql("entities " + _EDGES, """
    SELECT a.entity AS x, b.entity AS y, coalesce(t.weight, 0) AS weight
    FROM entities a JOIN entities b ON a.entity <> b.entity
    LEFT JOIN totals t ON t.x = a.entity AND t.y = b.entity"""))
def pair_universe(spark, sf_dir):
    return comentions.dense_pairs(_totals(spark, sf_dir), views.ENTITIES)


@query(sql("aliases messages mentions", """
    SELECT a.message_id, a.day, a.entity AS x, b.entity AS y
    FROM mentions a JOIN mentions b ON a.message_id = b.message_id AND a.entity <> b.entity"""))
def comention_pairs(spark, sf_dir):
    return comentions.comention_pairs(_sets(spark, sf_dir))


@query(sql("aliases messages mentions edges", "SELECT day, x, y, weight FROM edges"))
def edges_daily(spark, sf_dir):
    return comentions.edges_daily(_sets(spark, sf_dir))


@query(sql("aliases messages mentions edges", """
    SELECT x, y, CAST(sum(weight) AS BIGINT) AS weight FROM edges WHERE day BETWEEN 3 AND 26 GROUP BY x, y"""))
def edges_total(spark, sf_dir):
    return comentions.edges_total(comentions.edges_daily(_sets(spark, sf_dir)), 3, 26)


def _power_sql(rounds: int = 40) -> str:
    """(A + I)^rounds applied to ones, each round scaled by the largest weight."""
    steps = [
        "links AS (SELECT x, y, weight / CAST((SELECT max(weight) FROM totals) AS DOUBLE) AS w FROM totals "
        "UNION ALL SELECT entity, entity, 1 / CAST((SELECT max(weight) FROM totals) AS DOUBLE) FROM entities)",
        "v0 AS (SELECT entity, CAST(1 AS DOUBLE) AS v FROM entities)",
    ]
    for i in range(rounds):
        steps.append(
            f"v{i + 1} AS MATERIALIZED (SELECT x AS entity, sum(w * v) AS v FROM links JOIN v{i} ON y = entity GROUP BY x)"
        )
    steps.append(
        f"scores AS (SELECT entity, v / sqrt((SELECT sum(v * v) FROM v{rounds})) AS centrality FROM v{rounds})"
    )
    return ", " + ",\n".join(steps) + "\n"


def _centrality(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Used by several jobs, so the texts are scanned once and the edges stored.
    ensure_checkpoint_dir(spark)
    totals = _totals(spark, sf_dir).checkpoint()
    return totals, centrality.eigenvector_centrality(totals, views.entities(spark), tolerance=1e-9)


@query(sql("entities " + _EDGES, _power_sql() + "SELECT entity, round(centrality, 6) AS centrality FROM scores"))
def centrality_scores(spark, sf_dir):
    return _centrality(spark, sf_dir)[1].withColumns(_round("centrality"))


for _registry in (QUERIES, ORACLES):
    _registry["centrality"] = _registry.pop("centrality_scores")


@query(sql("entities picked " + _EDGES, _power_sql() + """
    SELECT entity, round(centrality, 6) AS centrality FROM scores
    WHERE entity IN (SELECT entity FROM picked) ORDER BY centrality DESC, entity LIMIT 1"""))
def most_central(spark, sf_dir):
    scores = _centrality(spark, sf_dir)[1]
    return centrality.most_central(scores, views.picked(spark)).withColumns(_round("centrality"))


@query(sql("picked " + _EDGES + " subgraph", "SELECT x, y, weight, x || ' to ' || y AS label FROM subgraph"))
def picked_subgraph(spark, sf_dir):
    return comentions.picked_subgraph(_totals(spark, sf_dir), views.picked(spark))


@query(sql("picked " + _EDGES + " subgraph", """
    SELECT x AS name, arg_min(y, (-weight, y)) AS closest_neighbor, max(weight) AS weight
    FROM subgraph GROUP BY x"""))
def closest_neighbor(spark, sf_dir):
    graph = comentions.picked_subgraph(_totals(spark, sf_dir), views.picked(spark))
    return comentions.closest_neighbors(graph)


@query(sql("entities picked " + _EDGES + " subgraph", _power_sql() + """
    , nearest AS (SELECT x AS name, arg_min(y, (-weight, y)) AS closest_neighbor FROM subgraph GROUP BY x)
    SELECT name, printf('%.2f%%', centrality * 100) AS centrality, closest_neighbor
    FROM nearest JOIN scores ON entity = name"""))
def graph_nodes(spark, sf_dir):
    totals, scores = _centrality(spark, sf_dir)
    graph = comentions.picked_subgraph(totals, views.picked(spark))
    return comentions.graph_nodes(graph, scores)


@query(sql(_EDGES, """
    SELECT x AS name, y AS partner, weight, round(weight / sum(weight) OVER (), 6) AS share,
           CAST(row_number() OVER (ORDER BY weight DESC, y) AS INTEGER) AS rank
    FROM totals WHERE x = 'Hope Lark'"""))
def partner_breakdown(spark, sf_dir):
    shares = comentions.partner_breakdown(_totals(spark, sf_dir), "Hope Lark")
    return shares.withColumns(_round("share"))


@query(sql(_EDGES, "SELECT x AS name, y AS partner, weight FROM totals"))
def comention_matrix(spark, sf_dir):
    return comentions.comention_matrix(_totals(spark, sf_dir))


# ---------------------------------------------------------------- joins on time


@query(sql("messages timed_events", """
    , marks AS (SELECT epoch, max((type, event_id)) AS event FROM timed_events GROUP BY epoch)
    SELECT message_id, created_epoch, event[1] AS type, event[2] AS event_id, epoch
    FROM messages ASOF LEFT JOIN marks ON created_epoch >= epoch"""))
def last_event_before_message(spark, sf_dir):
    """Each message with the latest timeline event at or before it."""
    asked = views.messages(spark, sf_dir).select("message_id", "created_epoch")
    marks = views.timed_events(spark, sf_dir).select("epoch", "type", "event_id")
    found = temporal.asof_join(asked, marks, "created_epoch", "epoch")
    return found.select("message_id", "created_epoch", "match.type", "match.event_id", "match.epoch")


@query(sql("aliases messages timed_mentions timed_events", """
    , marks AS (SELECT entity, created_epoch, max((message_id, n)) AS m FROM timed_mentions GROUP BY entity, created_epoch)
    SELECT event_id, e.entity, epoch, created_epoch AS mentioned, m[1] AS message_id, m[2] AS n
    FROM timed_events e ASOF LEFT JOIN marks ON e.entity = marks.entity AND epoch >= created_epoch"""))
def last_mention_before_event(spark, sf_dir):
    """Each timeline event with the latest message that mentions its entity at or before it."""
    rows = mentions.mention_rows(_scan(spark, sf_dir, carry=("created_epoch",)))
    marks = rows.select("entity", "created_epoch", "message_id", "n")
    asked = views.timed_events(spark, sf_dir).select("event_id", "entity", "epoch")
    found = temporal.asof_join(asked, marks, "epoch", "created_epoch", by=["entity"])
    return found.select("event_id", "entity", "epoch", F.col("match.created_epoch").alias("mentioned"), "match.message_id", "match.n")


@query(sql("aliases messages mentions daily roster", """
    SELECT entity, entry_day, leave_day, CAST(count(DISTINCT day) AS BIGINT) AS days, CAST(sum(n) AS BIGINT) AS n
    FROM roster JOIN daily USING (entity)
    WHERE day BETWEEN entry_day AND coalesce(leave_day, 1000000) GROUP BY entity, entry_day, leave_day"""))
def mentions_in_stints(spark, sf_dir):
    """Mentions of each entity during each of its stints; a stint without a leave day is open."""
    met = temporal.interval_join(
        _daily(spark, sf_dir), views.roster(spark).select("entity", "entry_day", "leave_day"), "day", "entry_day", "leave_day", by=["entity"])
    return met.groupBy("span.entity", "span.entry_day", "span.leave_day").agg(
        F.count_distinct("point.day").alias("days"), F.sum("point.n").alias("n"))


_AFTER = 900


@query(sql("messages timed_events", f"""
    SELECT event_id, type, count(*) AS messages, CAST(sum(score) AS BIGINT) AS score
    FROM timed_events JOIN messages ON created_epoch BETWEEN epoch AND epoch + {_AFTER} GROUP BY event_id, type"""))
def messages_after_events(spark, sf_dir):
    """Messages in the quarter of an hour after each event."""
    events = views.timed_events(spark, sf_dir).select("event_id", "type", "epoch", (F.col("epoch") + _AFTER).alias("until"))
    asked = views.messages(spark, sf_dir).select("created_epoch", "score")
    met = temporal.interval_join(asked, events, "created_epoch", "epoch", "until", grain=_AFTER)
    return met.groupBy("span.event_id", "span.type").agg(F.count("*").alias("messages"), F.sum("point.score").alias("score"))


@query(sql("raw_roster clean_roster", """
    SELECT a.entity, a.entry_day AS first_entry, b.entry_day AS second_entry,
           least(coalesce(a.leave_day, 1000), coalesce(b.leave_day, 1000)) - greatest(a.entry_day, b.entry_day) + 1 AS days
    FROM clean_roster a JOIN clean_roster b ON a.entity = b.entity AND (a.entry_day, a.hometown) < (b.entry_day, b.hometown)
    WHERE a.entry_day <= coalesce(b.leave_day, 1000) AND b.entry_day <= coalesce(a.leave_day, 1000)
      AND a.entry_day <= coalesce(a.leave_day, 1000) AND b.entry_day <= coalesce(b.leave_day, 1000)"""))
def overlapping_stints(spark, sf_dir):
    """Pairs of stints of one name that have days in common, with their number; open stints reach day 1000."""
    stints = roster.clean_roster(views.raw_roster(spark, sf_dir)).select(
        "entity", "hometown", "entry_day", F.coalesce("leave_day", F.lit(1000)).alias("leave_day"))
    met = temporal.overlap_join(stints, stints, "entry_day", "leave_day", by=["entity"])
    pairs = met.where("struct(left.entry_day, left.hometown) < struct(right.entry_day, right.hometown)")
    days = F.least("left.leave_day", "right.leave_day") - F.greatest("left.entry_day", "right.entry_day") + 1
    return pairs.select("left.entity", F.col("left.entry_day").alias("first_entry"), F.col("right.entry_day").alias("second_entry"), days.alias("days"))


# ---------------------------------------------------------------- ranked search


def _ranked_sql(texts: str, key: str, queries: str, k: int = 10) -> str:
    cut = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_'']+')"
    return f"""
        cut AS (SELECT {key}, {cut.format('body')} AS terms FROM ({texts})),
        lengths AS (SELECT {key}, len(terms) AS length FROM cut WHERE len(terms) > 0),
        totals AS (SELECT count(*) AS total, avg(length) AS mean FROM lengths),
        found AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(terms) AS term FROM cut) GROUP BY {key}, term),
        frequency AS (SELECT term, count(*) AS df FROM found GROUP BY term),
        asked AS (SELECT DISTINCT query_id, unnest({cut.format('query')}) AS term FROM ({queries})),
        scored AS (
            SELECT query_id, {key}, round(sum(
                ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * {search.SATURATION + 1}
                / (tf + {search.SATURATION} * ({1 - search.LENGTH_SHARE} + {search.LENGTH_SHARE} * length / mean))), {search.DIGITS}) AS score
            FROM asked JOIN found USING (term) JOIN frequency USING (term) JOIN lengths USING ({key}), totals
            GROUP BY query_id, {key}),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, {key}, score FROM ranked WHERE rank <= {k}"""


@query(sql("messages", "," + _ranked_sql("SELECT message_id, body FROM messages", "message_id", "SELECT item_id AS query_id, text AS query FROM benchmark")))
def ranked_messages(spark, sf_dir):
    """The messages that suit each benchmark passage best, from postings that are stored once."""
    stored = written(search.postings(views.messages(spark, sf_dir)))
    asked = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(stored, asked)


_THREAD_QUERIES = ["Daily Discussion post", "Post Episode 42", "pre 7"]


@query(sql("threads", "," + _ranked_sql(
    "SELECT thread_id, title || ' ' || AuthorName AS body FROM threads", "thread_id",
    "SELECT CAST(i AS BIGINT) AS query_id, query FROM (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_THREAD_QUERIES)) + ") AS q(i, query)", 20)))
def ranked_threads(spark, sf_dir):
    """Threads by relevance of their title and author to a query text."""
    ensure_checkpoint_dir(spark)
    shown = views.threads(spark, sf_dir).select("thread_id", F.concat("title", F.lit(" "), "AuthorName").alias("body"))
    stored = search.postings(shown, "thread_id", carry=()).checkpoint()
    asked = local_table(spark, list(enumerate(_THREAD_QUERIES)), query_id=pa.int64(), query=pa.string())
    return search.search(stored, asked, 20, "thread_id")


_PULL_QUERY = "Daily Discussion post of the day"


@query(sql("lines options", f""", best AS (WITH {_ranked_sql(
        f"SELECT 't-' || doc_id AS id, concat_ws(' ', {TITLE_SQL}, text) AS body FROM documents WHERE {CREATED_SQL} >= {_SINCE}", "id",
        f"SELECT CAST(0 AS BIGINT) AS query_id, '{_PULL_QUERY}' AS query", 20)}),
    pulled AS (
        SELECT 'thread' AS kind, * FROM ({_THREAD_SQL})
        UNION ALL BY NAME SELECT 'message' AS kind, * FROM ({_MESSAGE_SQL})
        UNION ALL BY NAME SELECT 'poll' AS kind, * FROM ({_POLL_SQL})
        UNION ALL BY NAME SELECT 'option' AS kind, * FROM ({_OPTION_SQL}))
    SELECT rank, pulled.* FROM pulled JOIN best ON "PostID" = id"""))
def ranked_pull(spark, sf_dir):
    """All four tables of the threads that suit a query text best, from one pass over the found threads' nested rows."""
    return submissions.ranked_pull(views.submissions(spark, sf_dir), _PULL_QUERY, NOW, 20, _SINCE)


# ---------------------------------------------------------------- windows and silences, the streams' batch forms


@query(sql("aliases messages timed_mentions", """
    , starts AS (SELECT created_epoch // 21600 * 21600 - 21600 * i AS start, entity, n FROM timed_mentions, range(4) AS r(i))
    SELECT start, entity, count(*) AS messages, CAST(sum(n) AS BIGINT) AS n FROM starts GROUP BY start, entity"""))
def sliding_mentions(spark, sf_dir):
    """Mentions of each entity in windows of a day, every six hours."""
    rows = mentions.mention_rows(_scan(spark, sf_dir, carry=("created_epoch",)))
    return windows.sliding_mentions(rows.select("created_epoch", "entity", "n"))


_SILENCE = 5_400


@query(sql("aliases messages timed_mentions", f"""
    , moments AS (SELECT DISTINCT entity, created_epoch FROM timed_mentions),
    gaps AS (SELECT entity, lag(created_epoch) OVER (PARTITION BY entity ORDER BY created_epoch) AS since, created_epoch AS until FROM moments)
    SELECT entity, since, until, until - since AS seconds FROM gaps WHERE until - since >= {_SILENCE}"""))
def silences(spark, sf_dir):
    """Stretches of an hour and a half or more in which an entity is not mentioned."""
    rows = mentions.mention_rows(_scan(spark, sf_dir, carry=("created_epoch",)))
    return state.silences_of(rows, "created_epoch", _SILENCE)


# ---------------------------------------------------------------- paths and components


@query(sql("aliases entities messages mentions edges totals", """
    , closest AS (SELECT x, arg_min(y, (-weight, y)) AS y FROM totals GROUP BY x),
    links AS (SELECT x, y FROM closest UNION SELECT y, x FROM closest),
    walks(entity, hops) AS (
        SELECT 'Amber Vale', 0 UNION SELECT y, hops + 1 FROM walks JOIN links ON entity = x WHERE hops < 10)
    SELECT entity, CAST(min(hops) AS INTEGER) AS hops FROM entities LEFT JOIN walks USING (entity) GROUP BY entity""").replace("WITH ", "WITH RECURSIVE ", 1))
def hop_distances(spark, sf_dir):
    """Steps from one entity to all others along closest-neighbour ties."""
    totals = comentions.edges_total(comentions.edges_daily(_sets(spark, sf_dir)))
    ties = comentions.closest_neighbors(totals).select(F.col("name").alias("x"), F.col("closest_neighbor").alias("y"))
    links = ties.unionByName(ties.select(F.col("y").alias("x"), F.col("x").alias("y")))
    start = views.entities(spark).where("entity = 'Amber Vale'")
    return paths.hop_distances(links, start, views.entities(spark))


_RUN_DAYS = (1, 3)


@query(f"""
    WITH errors AS (
        SELECT user_id, min(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER)) AS day
        FROM events WHERE event_type = 'error' GROUP BY user_id),
    days AS (SELECT CAST(d AS INTEGER) AS until FROM range({_RUN_DAYS[0]}, {_RUN_DAYS[1] + 1}) AS r(d)),
    nodes AS (
        SELECT DISTINCT until, user_id + i AS node FROM days, errors, range(2) AS s(i) WHERE day <= until),
    links AS (SELECT until, user_id AS node FROM days, errors WHERE day <= until),
    runs AS (
        SELECT n.until, n.node, CASE WHEN l.node IS NULL THEN n.node END AS head
        FROM nodes n LEFT JOIN links l ON l.until = n.until AND l.node = n.node - 1)
    SELECT until AS day, node, max(head) OVER (PARTITION BY until ORDER BY node) AS component FROM runs""")
def components_by_day(spark, sf_dir):
    """Users whose errors link them to the next user, joined up day by day."""
    events = views.table(spark, sf_dir, "events").where("event_type = 'error'")
    day = (F.datediff("ts", F.lit("2024-01-01")) + 1).alias("day")
    links = events.select(day, F.col("user_id").alias("x"), (F.col("user_id") + 1).alias("y")).distinct()
    return paths.components_by_day(links, *_RUN_DAYS)


# ---------------------------------------------------------------- merging aggregates, cubes, trailing windows, local days


@query(sql("aliases messages mentions", """
    , ranked AS (
        SELECT entity, compound, row_number() OVER (PARTITION BY entity ORDER BY compound) AS place, count(*) OVER (PARTITION BY entity) AS total
        FROM mentions WHERE day BETWEEN 3 AND 26)
    SELECT entity, max(total) AS n, max(compound) FILTER (place = (total * 50 + 99) // 100) AS p50,
           max(compound) FILTER (place = (total * 90 + 99) // 100) AS p90
    FROM ranked GROUP BY entity"""))
def sentiment_percentiles(spark, sf_dir):
    """Median and 90th percentile of the compound score per entity, from histograms by day."""
    stored = summaries.value_histogram(_rows(spark, sf_dir), "compound", ["day", "entity"])
    return summaries.percentiles(calendar.within_days(stored, 3, 26), ["entity"])


@query(sql("aliases messages", r"""
    , tokens AS (SELECT message_id, thread_id, day, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS alias FROM messages)
    SELECT entity, count(DISTINCT message_id) AS messages, true AS close
    FROM tokens JOIN aliases USING (alias) WHERE day BETWEEN 3 AND 26 GROUP BY entity"""))
def distinct_messages(spark, sf_dir):
    """Distinct messages per entity over a range of days, and whether the merged daily sketches come within 4 % of them."""
    rows = calendar.within_days(_rows(spark, sf_dir), 3, 26)
    estimated = summaries.distinct_counts(summaries.distinct_sketches(rows, "message_id", ["day", "entity"]), ["entity"])
    exact = rows.groupBy("entity").agg(F.count_distinct("message_id").alias("messages"))
    close = F.abs(F.col("estimate") - F.col("messages")) <= F.greatest(F.lit(1.0), F.col("messages") * 0.04)
    return exact.join(estimated, "entity").select("entity", "messages", close.alias("close"))


@query(sql("aliases messages threads", r"""
    , tokens AS (
        SELECT message_id, thread_id, author, day, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS alias FROM messages),
    counted AS (SELECT thread_id, author, day, entity FROM tokens JOIN aliases USING (alias)),
    typed AS (
        SELECT day, entity, c.author, CASE WHEN title LIKE '%Daily Discussion%' THEN 'MID' WHEN lower(title) LIKE '%post%' THEN 'POST' ELSE 'PRE' END AS type
        FROM counted c JOIN threads t USING (thread_id))
    SELECT day, type, entity, CAST(grouping_id(day, type, entity) AS BIGINT) AS level, count(*) AS n, count(DISTINCT author) AS "distinct"
    FROM typed GROUP BY CUBE (day, type, entity)"""))
def mention_cube(spark, sf_dir):
    """Mentions and distinct authors by day, thread type and entity, and all their totals."""
    rows = mentions.mention_rows(_scan(spark, sf_dir, carry=("day", "thread_id", "author")))
    typed = views.threads(spark, sf_dir).select("thread_id", labels.thread_type(F.col("title")).alias("type"))
    return summaries.cube_counts(rows.join(typed, "thread_id"), ["day", "type", "entity"], "n", "author")


@query(sql("aliases messages mentions daily", """
    SELECT day, entity, n,
           round(coalesce((SELECT sum(b.n) FROM daily b WHERE b.entity = a.entity AND b.day BETWEEN a.day - 6 AND a.day), 0) / 7.0, 6) AS mean,
           round(coalesce((SELECT sum(b.n) FROM daily b WHERE b.entity = a.entity AND b.day BETWEEN a.day - 6 AND a.day), 0) / 7.0
           - coalesce((SELECT sum(b.n) FROM daily b WHERE b.entity = a.entity AND b.day BETWEEN a.day - 13 AND a.day - 7), 0) / 7.0, 6) AS change
    FROM daily a"""))
def trailing_mentions(spark, sf_dir):
    """Mean of the last seven days per entity and day, and its change against the seven days before."""
    return summaries.trailing(_daily(spark, sf_dir)).withColumns(_round("mean", "change"))


_ZONE, _ZONE_ORIGIN = "Europe/Berlin", "2024-03-20"
# The moments of 2024 at which that zone goes to summer time and back.
_SUMMER, _WINTER = 1_711_846_800, 1_729_990_800
_SEASONS = (78, 288)


@query(sql("aliases messages timed_mentions", f"""
    , moved AS (SELECT created_epoch + s * 86400 AS moment, entity, n FROM timed_mentions, (VALUES {', '.join(f'({s})' for s in _SEASONS)}) AS v(s)),
    local AS (SELECT entity, n, moment + CASE WHEN moment >= {_SUMMER} AND moment < {_WINTER} THEN 7200 ELSE 3600 END AS wall FROM moved),
    dated AS (SELECT entity, n, CAST(date_diff('day', DATE '{_ZONE_ORIGIN}', DATE '1970-01-01' + CAST(wall // 86400 AS INTEGER)) + 1 AS INTEGER) AS day FROM local)
    SELECT day, CASE WHEN day = 12 THEN 23 WHEN day = 222 THEN 25 ELSE 24 END AS hours, entity, CAST(sum(n) AS BIGINT) AS n
    FROM dated GROUP BY day, entity"""))
def daily_mentions_local(spark, sf_dir):
    """Mentions per day of a zone's own calendar, over two seasons in which its clocks change."""
    rows = mentions.mention_rows(_scan(spark, sf_dir, carry=("created_epoch",)))
    seasons = F.explode(F.array(*[F.col("created_epoch") + s * 86_400 for s in _SEASONS])).alias("at")
    moved = rows.select("entity", "n", seasons)
    local = moved.select("entity", "n", calendar.local_day_index(F.col("at"), _ZONE, _ZONE_ORIGIN).alias("day"))
    series = daily.daily_mentions(local)
    return series.select("day", calendar.local_day_hours(F.col("day"), _ZONE, _ZONE_ORIGIN).alias("hours"), "entity", "n")
