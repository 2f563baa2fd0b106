"""Views of the discussion model on the driver's tables, as DataFrames and as SQL.

Both forms state the same arithmetic over whole tables. Small dictionaries (aliases of the text
queries, their roster) are parameters of queries that read `documents`; dictionary and roster
operators themselves run on dictionaries and rosters derived from `customer`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import day_index
from ..operators.aliases import AliasBook
from ..session import local_table, selection

ORIGIN = 1_704_067_200
NOW = ORIGIN + 40 * 86_400
FIRST, LAST = 1, 30

ALIASES = {
    "Amber Vale": ["And"],
    "Bryn Holt": ["By"],
    "Cole Frost": ["For", "From"],
    "Dana Reed": ["In", "Is"],
    "Elis Ward": ["It"],
    "Fay North": ["Of", "On"],
    "Gale Moss": ["That", "This"],
    "Hope Lark": ["The"],
    "Ivor Penn": ["To"],
    "June West": ["Was", "With"],
}
ENTITIES = list(ALIASES)
PICKED = ["Amber Vale", "Cole Frost", "Dana Reed", "Fay North", "Hope Lark", "June West"]
# entity, entry_day, leave_day, leave_status, main_entry_day
ROSTER = [
    ("Amber Vale", 1, 9, "Dumped", 1),
    ("Amber Vale", 12, 28, "Winner", None),
    ("Bryn Holt", 1, 4, "Dumped", 1),
    ("Cole Frost", 1, 11, "Dumped", 1),
    ("Dana Reed", 2, 15, "Dumped", 2),
    ("Elis Ward", 3, None, None, 3),
    ("Fay North", 5, 15, "Dumped", 5),
    ("Gale Moss", 26, 29, "Third", None),
    ("Hope Lark", 27, 20, "Dumped", 31),
    ("Ivor Penn", 1, 22, "Dumped", 1),
    ("June West", 6, 17, "Dumped", 6),
]
NEGATIONS = ["no", "not", "non", "nicht", "sin"]
BOOSTERS = {"the": 0.293, "un": -0.293}


def book() -> AliasBook:
    return AliasBook(tuple((alias, entity) for entity, names in ALIASES.items() for alias in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    created = F.lit(ORIGIN) + doc * 7919 % 2_592_000
    return table(spark, sf_dir, "documents").select(
        doc.alias("message_id"),
        F.floor(doc / 10).cast("bigint").alias("thread_id"),
        created.alias("created_epoch"),
        day_index(created, ORIGIN).alias("day"),
        F.col("text").alias("body"),
        F.col("source").alias("author"),
        (doc * 13 % 50).alias("score"),
        ((doc * 37 % 201 - 100) / F.lit(100.0).cast("double")).alias("compound"),
        F.concat(F.lit("/m/"), doc.cast("string")).alias("permalink"),
        (created + 3600).alias("inserted_epoch"),
    )


def title() -> Column:
    doc = F.col("doc_id")
    return F.concat(
        F.when(doc % 4 == 0, F.lit("Daily Discussion "))
        .when(doc % 4 == 1, F.lit("Post Episode "))
        .when(doc % 4 == 2, F.lit("Daily Discussion post "))
        .otherwise(F.lit("Pre Episode ")),
        doc.cast("string"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per document: its lines are messages (short ones placeholders), the sentences of
    an English one the options of a poll."""
    doc = F.col("doc_id")
    key = doc.cast("string")
    created = F.lit(ORIGIN) + doc * 7919 % 2_592_000
    author = F.struct(F.concat(F.lit("a-"), F.col("source")).alias("id"), F.col("source").alias("name"))
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(F.length(line) < 40, F.lit("more")).otherwise(F.lit("comment")).alias("kind"),
            F.concat(key, F.lit("-"), i.cast("string")).alias("id"),
            F.concat(F.lit("/m/"), key, F.lit("/"), i.cast("string")).alias("permalink"),
            F.when(i % 5 != 0, author).alias("author"),
            (created + i).alias("created_utc"),
            line.alias("body"),
            (F.length(line) % 50).cast("bigint").alias("score"),
            F.concat(F.lit("t-"), key).alias("parent_id"),
        ),
    )
    options = F.transform(
        F.split("text", r"\. "),
        lambda text, i: F.struct(
            F.concat(key, F.lit("/"), i.cast("string")).alias("id"),
            text.alias("text"),
            (F.length(text) % 100).cast("bigint").alias("vote_count"),
        ),
    )
    poll = F.struct(
        (doc * 3).alias("total_vote_count"),
        (created + 86_400).alias("voting_end_timestamp"),
        options.alias("options"),
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("t-"), key).alias("id"),
        F.concat(F.lit("n-"), key).alias("name"),
        title().alias("title"),
        F.concat(F.lit("/t/"), key).alias("permalink"),
        created.alias("created_utc"),
        F.when(doc % 10 != 0, author).alias("author"),
        (doc % 50 == 0).alias("stickied"),
        F.col("lang").alias("link_flair_text"),
        F.concat(F.lit("http://example.com/"), key).alias("url"),
        (doc % 20 == 0).alias("locked"),
        F.when(doc % 6 == 0, created + 60).alias("edited"),
        F.size(lines).cast("bigint").alias("num_comments"),
        F.col("text").alias("selftext"),
        (doc * 13 % 50).alias("score"),
        (doc % 100 / F.lit(100.0).cast("double")).alias("upvote_ratio"),
        lines.alias("comments"),
        F.when(F.col("lang") == "en", poll).alias("poll_data"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored threads."""
    doc = F.col("doc_id")
    created = F.lit(ORIGIN) + doc * 7919 % 2_592_000
    return table(spark, sf_dir, "documents").select(
        doc.alias("thread_id"),
        title().alias("title"),
        created.alias("createdDate"),
        F.col("text").alias("selfText"),
        (doc * 13 % 50).alias("score"),
        F.col("source").alias("AuthorName"),
        F.concat(F.lit("/t/"), doc.cast("string")).alias("permalink"),
        (created + 3600).alias("insertionTimestamp"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline row per event; an event is its type and hour, its entity follows from the user."""
    nth = F.element_at(F.array(*map(F.lit, ENTITIES)), (F.col("user_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        (F.datediff("ts", F.lit("2024-01-01")) + 1).alias("day"),
        F.col("event_type").alias("type"),
        F.concat("event_type", F.lit(" at "), F.hour("ts").cast("string")).alias("summary"),
        nth.alias("entity"),
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline rows with their moment in epoch seconds."""
    nth = F.element_at(F.array(*map(F.lit, ENTITIES)), (F.col("user_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), F.col("event_type").alias("type"), nth.alias("entity")
    )


def roster(spark: SparkSession) -> DataFrame:
    text, day = pa.string(), pa.int32()
    return local_table(
        spark, ROSTER, entity=text, entry_day=day, leave_day=day, leave_status=text, main_entry_day=day
    )


def picked(spark: SparkSession) -> DataFrame:
    return selection(spark, PICKED)


def entities(spark: SparkSession) -> DataFrame:
    return selection(spark, ENTITIES)


def raw_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entrants: some share a name, some have none, some days have a digit glued on."""
    key = F.col("c_custkey")
    day = key % 40 + 1
    glued = (key % 9 == 0) & (day > 20)
    number = (key - F.when(key % 11 == 10, F.lit(1)).otherwise(F.lit(0))).cast("string")
    state = F.concat(F.lit(" (Day "), (day + key % 25).cast("string"), F.lit(")"))
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("row_no"),
            F.when(F.col("n_nationkey") > 0, F.concat("c_mktsegment", F.lit(" Entrant "), number)).alias("Islander"),
            (key % 20 + 18).cast("string").alias("Age"),
            F.col("n_name").alias("Hometown"),
            F.concat(F.lit("Day "), day.cast("string"), F.when(glued, F.lit("1")).otherwise(F.lit(""))).alias("Entered"),
            F.when(key % 4 == 0, F.lit("Participating"))
            .otherwise(
                F.concat(
                    F.when(key % 4 == 1, F.lit("Dumped"))
                    .when(key % 4 == 2, F.lit("Winner"))
                    .otherwise(F.lit("Walked")),
                    state,
                )
            )
            .alias("Status"),
        )
    )


def wide_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with up to three aliases; the segment is one that a fifth of all rows share."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("row_no"),
        F.col("c_name").alias("entity"),
        F.concat(F.lit("C"), (key % 700).cast("string")).alias("alias_1"),
        F.when(key % 3 == 0, F.col("c_mktsegment")).alias("alias_2"),
        F.concat(F.lit("C"), key.cast("string")).alias("alias_3"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the benchmark texts, with a valence that follows from their length."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)))
    distinct = table(spark, sf_dir, "benchmark").select(words.alias("token")).distinct()
    return distinct.select("token", (F.length("token") * 7 % 9 - 4).cast("double").alias("valence"))


def word_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the benchmark texts, thousands of them, as aliases of entities by their first letter."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    distinct = table(spark, sf_dir, "benchmark").select(words.alias("alias")).distinct()
    first = F.concat(F.lit("Letter "), F.substring("alias", 1, 1))
    return distinct.select("alias", first.alias("entity"), F.length("alias").alias("alias_order"))


# The same views as DuckDB common table expressions.

def _values(rows: list[tuple]) -> str:
    def literal(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


_ALIAS_ROWS = [
    (alias, entity, i) for i, (alias, entity) in enumerate((a, e) for e, names in ALIASES.items() for a in names)
]
_CREATED = f"{ORIGIN} + doc_id * 7919 % 2592000"
_DAY = f"CAST(floor((({_CREATED}) - {ORIGIN}) / 86400) + 1 AS INTEGER)"
_TITLE = (
    "CASE doc_id % 4 WHEN 0 THEN 'Daily Discussion ' WHEN 1 THEN 'Post Episode ' "
    "WHEN 2 THEN 'Daily Discussion post ' ELSE 'Pre Episode ' END || doc_id"
)

SQL = {
    "aliases": f"aliases(alias, entity, alias_order) AS ({_values(_ALIAS_ROWS)})",
    "entities": f"entities(entity) AS ({_values([(e,) for e in ENTITIES])})",
    "picked": f"picked(entity) AS ({_values([(e,) for e in PICKED])})",
    "roster": f"roster(entity, entry_day, leave_day, leave_status, main_entry_day) AS ({_values(ROSTER)})",
    "messages": f"""messages AS (
        SELECT doc_id AS message_id, CAST(floor(doc_id / 10) AS BIGINT) AS thread_id,
               {_CREATED} AS created_epoch, {_DAY} AS day, text AS body, source AS author,
               doc_id * 13 % 50 AS score, (doc_id * 37 % 201 - 100) / CAST(100 AS DOUBLE) AS compound,
               '/m/' || doc_id AS permalink, {_CREATED} + 3600 AS inserted_epoch
        FROM documents)""",
    "threads": f"""threads AS (
        SELECT doc_id AS thread_id, {_TITLE} AS title, {_CREATED} AS createdDate, text AS selfText,
               doc_id * 13 % 50 AS score, source AS AuthorName, '/t/' || doc_id AS permalink,
               {_CREATED} + 3600 AS insertionTimestamp
        FROM documents)""",
    # Whole-word mentions, found by comparing every word with the dictionary.
    "mentions": r"""tokens AS (
        SELECT message_id, day, compound, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS alias
        FROM messages),
    mentions AS (
        SELECT message_id, day, compound, entity, count(*) AS n
        FROM tokens JOIN aliases USING (alias) GROUP BY message_id, day, compound, entity)""",
    "word_aliases": r"""word_aliases AS (
        SELECT DISTINCT alias, 'Letter ' || alias[1] AS entity
        FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS alias FROM benchmark))""",
    "daily": """daily AS (
        SELECT day, entity, CAST(sum(n) AS BIGINT) AS n FROM mentions GROUP BY day, entity)""",
    "days": "days AS (SELECT DISTINCT day FROM daily)",
    "dense": """dense AS (
        SELECT d.day, e.entity, coalesce(m.n, 0) AS n
        FROM days d CROSS JOIN entities e LEFT JOIN daily m ON m.day = d.day AND m.entity = e.entity)""",
    "daily_sentiment": """daily_sentiment AS (
        SELECT day, entity, avg(compound) AS sentiment FROM mentions GROUP BY day, entity)""",
    "dense_sentiment": """dense_sentiment AS (
        SELECT d.day, e.entity, coalesce(s.sentiment, 0) AS sentiment
        FROM days d CROSS JOIN entities e LEFT JOIN daily_sentiment s ON s.day = d.day AND s.entity = e.entity)""",
    "exits": """exits AS (
        SELECT entity, max(leave_day) AS leave_day FROM roster GROUP BY entity
        HAVING count(*) = count(leave_day))""",
    "timeline": f"""names AS (SELECT {ENTITIES!r} AS list),
    timeline AS (
        SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day,
               event_type AS type, event_type || ' at ' || hour(ts) AS summary,
               list[user_id % 10 + 1] AS entity
        FROM events, names)""",
    "timed_events": f"""timed_events AS (
        SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch, event_type AS type,
               ({ENTITIES!r})[user_id % 10 + 1] AS entity
        FROM events)""",
    "timed_mentions": r"""timed_tokens AS (
        SELECT message_id, created_epoch, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS alias FROM messages),
    timed_mentions AS (
        SELECT message_id, created_epoch, entity, count(*) AS n
        FROM timed_tokens JOIN aliases USING (alias) GROUP BY message_id, created_epoch, entity)""",
    "edges": """edges AS (
        SELECT a.day, a.entity AS x, b.entity AS y, count(*) AS weight
        FROM mentions a JOIN mentions b ON a.message_id = b.message_id AND a.entity <> b.entity
        GROUP BY a.day, a.entity, b.entity)""",
    "totals": """totals AS (
        SELECT x, y, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY x, y)""",
    "subgraph": """subgraph AS (
        SELECT x, y, weight FROM totals
        WHERE x IN (SELECT entity FROM picked) AND y IN (SELECT entity FROM picked))""",
    "raw_roster": """raw_roster AS (
        SELECT c_custkey AS row_no,
               CASE WHEN n_nationkey > 0 THEN c_mktsegment || ' Entrant '
                    || (c_custkey - CASE WHEN c_custkey % 11 = 10 THEN 1 ELSE 0 END) END AS name,
               CAST(c_custkey % 20 + 18 AS VARCHAR) AS age, n_name AS hometown,
               'Day ' || (c_custkey % 40 + 1)
                    || CASE WHEN c_custkey % 9 = 0 AND c_custkey % 40 + 1 > 20 THEN '1' ELSE '' END AS entered,
               CASE c_custkey % 4 WHEN 0 THEN 'Participating' ELSE
                    CASE c_custkey % 4 WHEN 1 THEN 'Dumped' WHEN 2 THEN 'Winner' ELSE 'Walked' END
                    || ' (Day ' || (c_custkey % 40 + 1 + c_custkey % 25) || ')' END AS status
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "clean_roster": r"""numbers AS (
        SELECT row_no, name AS entity, CAST(age AS INTEGER) AS age, hometown, status,
               CAST(nullif(regexp_extract(entered, '[0-9]+'), '') AS INTEGER) AS entered,
               CAST(nullif(regexp_extract(status, '[0-9]+'), '') AS INTEGER) AS leave_day
        FROM raw_roster WHERE name IS NOT NULL),
    entered AS (
        SELECT *, CASE WHEN entered > 200 THEN CAST(CAST(entered AS VARCHAR)[1:2] AS INTEGER)
                       ELSE entered END AS entry_day
        FROM numbers),
    clean_roster AS (
        SELECT row_no, entity, age, hometown, entry_day, leave_day,
               CASE WHEN leave_day IS NOT NULL THEN string_split(status, ' ')[1] END AS leave_status,
               CASE WHEN entry_day > 25 AND entry_day < 30
                    THEN CASE WHEN leave_day IS NULL THEN 31 END ELSE entry_day END AS main_entry_day
        FROM entered)""",
    "dictionary": """cells AS (
        SELECT 0 AS column_no, c_custkey AS row_no, c_name AS entity, 'C' || (c_custkey % 700) AS alias
        FROM customer
        UNION ALL
        SELECT 1, c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END FROM customer
        UNION ALL
        SELECT 2, c_custkey, c_name, 'C' || c_custkey FROM customer),
    dictionary AS (
        SELECT alias, arg_max(entity, (column_no, row_no)) AS entity, min((column_no, row_no)) AS place
        FROM cells WHERE alias IS NOT NULL GROUP BY alias)""",
    "lines": f"""lines AS (
        SELECT doc_id, source, {_CREATED} AS created,
               unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents)""",
    "options": f"""options AS (
        SELECT doc_id, {_CREATED} AS created, unnest(string_split(text, '. ')) AS option,
               unnest(range(len(string_split(text, '. ')))) AS i
        FROM documents WHERE lang = 'en')""",
}
CREATED_SQL, TITLE_SQL = _CREATED, _TITLE


def sql(views: str, body: str) -> str:
    """`WITH` the named views, in the given order, then the body."""
    return "WITH " + ",\n".join(SQL[v] for v in views.split()) + "\n" + body
