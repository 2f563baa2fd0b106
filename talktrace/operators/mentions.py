"""Entity mentions in message texts.

A message is one row, so everything that concerns one message is computed inside that row. The
scan yields `found`, an array of (entity, n) sorted by entity; counting, listing and pairing the
entities of a message need no shuffle, and only their aggregates by day or entity do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import text
from ..session import written
from . import aliases as dictionaries
from .aliases import AliasBook, unique_aliases

# A literal map is searched from its start, so it serves small dictionaries; larger ones are looked up by tasks
# or joined. Which way is taken changes the plan, not the rows.
IN_ROW_ALIASES = 512
# Parts of texts that a task looks up at a time.
CHUNK_PARTS = 1 << 19
_FOUND = ArrayType(StructType([StructField("entity", StringType()), StructField("n", LongType())]))


def _unless_empty(array: str) -> Column:
    """The array as input of a generator.

    Spark infers `size(array) > 0` below a generator over a plain column and pushes that filter
    into the scan's projection, which would run the pattern a second time for every message. From
    a conditional nothing is inferred, and null yields no rows either.
    """
    return F.when(F.size(array) > 0, F.col(array))


def _tally(names: Column | str) -> Column:
    """Array of names to a name-sorted array of (entity, n)."""
    names = F.col(names) if isinstance(names, str) else names
    return F.transform(
        F.sort_array(F.array_distinct(names)),
        lambda e: F.struct(
            e.alias("entity"), F.size(F.filter(names, lambda n: n == e)).cast("bigint").alias("n")
        ),
    )


def _named(hits: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per message `found`, from the aliases in `hits` by a join with the dictionary.

    One row per message and distinct alias is joined. A row without an alias keeps messages without a hit.
    """
    each = hits.select(*keys, F.explode_outer("hits").alias("alias"))
    counted = each.groupBy(*keys, "alias").agg(F.count("alias").alias("k"))
    named = counted.join(aliases.select("alias", "entity"), "alias", "left").groupBy(*keys, "entity").agg(F.sum("k").alias("n"))
    mention = F.when(F.col("entity").isNotNull(), F.struct("entity", "n"))
    return named.groupBy(*keys).agg(F.sort_array(F.collect_list(mention)).alias("found"))


def _gathered(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and `bodies`, one row per message. Only the texts of rows that share their keys are shuffled."""
    repeated = written(messages.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    alone = messages.select(*keys, F.array("body").alias("bodies"))
    if repeated.isEmpty():
        return alone
    same = reduce(Column.__and__, [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    shared = messages.select(*keys, "body").alias("m").join(repeated.alias("r"), same, "left_semi")
    alone = alone.alias("m").join(repeated.alias("r"), same, "left_anti")
    return alone.unionByName(shared.groupBy(*keys).agg(F.collect_list("body").alias("bodies")))


def _taken(message: np.ndarray, at: np.ndarray, stop: np.ndarray, entity: np.ndarray) -> np.ndarray:
    """Places of the hits that a scan of each message from its start takes: at each place the longest, without overlaps."""
    order = np.lexsort((entity, -stop, at, message))
    taken, current, upto = [], -1, 0
    for i, m, begin, end in zip(order.tolist(), message[order].tolist(), at[order].tolist(), stop[order].tolist()):
        if m != current:
            current, upto = m, 0
        if begin >= upto:
            taken.append(i)
            upto = end
    return np.array(taken, dtype=np.int64)


def _found(message: np.ndarray, entity: np.ndarray, rows: int, names: pa.Array) -> pa.Array:
    """For each of so many messages the (entity, n) of its hits, by `names`, which are sorted."""
    cells, counts = np.unique(message * max(1, len(names)) + entity, return_counts=True)
    ends = np.searchsorted(cells, np.arange(rows + 1) * max(1, len(names))).astype(np.int32)
    entities = names.take(pa.array(cells % max(1, len(names))))
    pairs = pa.StructArray.from_arrays([entities, pa.array(counts.astype(np.int64))], ["entity", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def _with_found(keys: Sequence[str], schema: StructType) -> StructType:
    return StructType([*(schema[k] for k in keys), StructField("found", _FOUND)])


def _by_lookup(cut: DataFrame, entries: Sequence[tuple[str, str, int, str]], keys: Sequence[str], whole: bool) -> DataFrame:
    """Per message `found`, for a dictionary that a task holds: (alias, entity, number of parts, first part).

    `cut` has the keys and `texts`, the parts of each text of a message and whether the first is a word. A text's
    parts, and with longer aliases every sequence of parts that begins like one, are looked up by arrays. With `whole`
    sequences must begin and end at words' edges, and hits that overlap are settled. CHUNK_PARTS parts are handled at a time.
    """
    names = sorted({entity for _, entity, _, _ in entries})
    code = {name: i for i, name in enumerate(names)}
    sized = {}
    for alias, entity, size, first in sorted(entries, key=lambda e: e[2]):
        sized.setdefault(size, []).append((alias, first, code[entity]))
    shared = cut.sparkSession.sparkContext.broadcast((names, sized))  # at most MOST_IN_PLAN aliases

    def find(batches):
        names, sized = shared.value
        names = pa.array(names, pa.string())
        tables = None
        for batch in batches:
            texts = batch.column(len(keys))
            rows = texts.flatten()
            parts, starts = rows.field(0), rows.field(1).to_numpy(zero_copy_only=False).astype(bool)
            closes = texts.offsets.to_numpy().astype(np.int64)
            of_message, closes = np.repeat(np.arange(len(texts)), np.diff(closes)), closes - closes[0]
            ends = parts.offsets.to_numpy().astype(np.int64)
            ends, values = ends - ends[0], parts.flatten()
            if tables is None:
                tables = [
                    (size, pa.array([a for a, _, _ in own], values.type), pa.array(sorted({f for _, f, _ in own}), values.type),
                     np.array([c for _, _, c in own], dtype=np.int64))
                    for size, own in sized.items()
                ]
            alone = not whole or max(sized, default=1) == 1 and len(rows) == len(texts)
            hits, low, reached = [(np.zeros(0, np.int64),) * 2], 0, ends[closes]
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(reached, reached[low] + CHUNK_PARTS, side="right")) - 1)
                one, other = closes[low], closes[high]
                message, at, stop, entity = _hits(values, ends[one : other + 1], starts[one:other], tables, whole)
                message = of_message[one:other][message]
                taken = slice(None) if alone else _taken(message, at, stop, entity)
                hits.append((message[taken], entity[taken]))
                low = high
            message, entity = (np.concatenate(c) for c in zip(*hits))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], _found(message, entity, len(texts), names)], [*keys, "found"])

    return cut.select(*keys, "texts").mapInArrow(find, _with_found(keys, cut.schema))


def _hits(values: pa.Array, ends: np.ndarray, starts: np.ndarray, tables: list, whole: bool) -> tuple[np.ndarray, ...]:
    """text, place, end and entity of the sequences of parts that are aliases, for texts whose parts lie between `ends`."""
    own = values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    sizes = np.diff(ends)
    closed = starts == (sizes % 2 == 1)  # words and others alternate
    found = [(np.zeros(0, np.int64),) * 4]
    for size, aliases, firsts, entities in tables:
        if size == 1:
            index = pc.fill_null(pc.index_in(own, aliases), -1).to_numpy()
            place = np.flatnonzero(index >= 0)
            text_of = np.searchsorted(ends, place, side="right") - 1
        else:
            place = np.flatnonzero(pc.is_in(own, firsts).to_numpy(zero_copy_only=False))
            text_of = np.searchsorted(ends, place, side="right") - 1
            inside = place + size <= ends[text_of + 1]
            place, text_of = place[inside], text_of[inside]
            joined = pc.binary_join_element_wise(*[own.take(pa.array(place + i)) for i in range(size)], pa.scalar("", own.type))
            index = pc.fill_null(pc.index_in(joined, aliases), -1).to_numpy()
            place, text_of, index = place[index >= 0], text_of[index >= 0], index[index >= 0]
        entity = entities[index[place] if size == 1 else index]
        if whole:
            begins, stops = place == ends[text_of], place + size == ends[text_of + 1]
            good = (~begins | starts[text_of]) & (~stops | closed[text_of])
            place, text_of, entity = place[good], text_of[good], entity[good]
        at = place - ends[text_of]
        found.append((text_of, at, at + size, entity))
    return tuple(np.concatenate(c) for c in zip(*found))


def _whole_words_by_join(messages: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`found` of whole words for a dictionary of any size.

    A whole word begins and ends where word characters and others meet. So the text is cut in runs of either,
    and every sequence of runs up to the dictionary's longest is a candidate for a join by its text.
    Of the hits of a message those that a scan from its start would take are counted: at each place the
    longest, without overlaps.
    """
    sized = aliases.select("alias", "entity", F.size(text.runs(F.col("alias"))).alias("runs"))
    longest = sized.agg(F.max("runs")).first()[0]
    if longest is None:
        return messages.select(*keys, F.array().cast(_FOUND).alias("found"))
    cut = messages.select(*keys, text.runs(F.col("body")).alias("runs"))
    last = F.size("runs")
    sequences = F.flatten(F.transform(
        F.when(last > 0, F.sequence(F.lit(0), last - 1)),
        lambda at: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), last - at)),
            lambda n: F.struct(at.alias("at"), (at + n).alias("stop"), last.alias("last"), F.concat_ws("", F.slice("runs", at + 1, n)).alias("alias")),
        ),
    ))
    candidates = cut.select(*keys, F.inline(sequences))
    edge = (F.col("at") == 0) & ~text.starts_as_word(F.col("alias")) | (F.col("stop") == F.col("last")) & ~text.ends_as_word(F.col("alias"))
    hits = candidates.where(~edge).join(sized.select("alias", "entity"), "alias").select(*keys, F.struct("at", "stop", "entity").alias("hit"))
    nothing = messages.select(*keys, F.lit(None).cast("struct<at: int, stop: int, entity: string>").alias("hit"))
    gathered = hits.unionByName(nothing).groupBy(*keys).agg(F.collect_list("hit").alias("hits"))

    def settle(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            message = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at, stop, entity = (lists.flatten().field(i) for i in range(3))
            names = pa.array(sorted(entity.unique().to_pylist()), entity.type)
            code = pc.index_in(entity, names).to_numpy().astype(np.int64)
            taken = _taken(message, at.to_numpy(), stop.to_numpy(), code)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], _found(message[taken], code[taken], len(lists), names)], [*keys, "found"])

    return gathered.mapInArrow(settle, _with_found(keys, gathered.schema))


def _entries(aliases: DataFrame) -> list[tuple[str, str, int, str]] | None:
    """The dictionary for a lookup in tasks, or none if it has more than MOST_IN_PLAN aliases."""
    cut = text.runs(F.col("alias"))
    rows = aliases.select("alias", "entity", F.size(cut), cut[0]).limit(dictionaries.MOST_IN_PLAN + 1).collect()
    return None if len(rows) > dictionaries.MOST_IN_PLAN else [tuple(r) for r in rows]


def _whole_words(messages: DataFrame, aliases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`found` of whole words: tasks look aliases up, or join them if they are too many to be held."""
    entries = _entries(aliases)
    if entries is None:
        return _whole_words_by_join(messages, aliases, keys)
    texts = F.transform("bodies", lambda b: F.struct(text.runs(b).alias("parts"), text.starts_as_word(b).alias("starts")))
    return _by_lookup(_gathered(messages, keys).select(*keys, texts.alias("texts")), entries, keys, True)


def scan_mentions(
    messages: DataFrame,
    aliases: DataFrame | AliasBook,
    boundary: str = "word",
    carry: Sequence[str] = ("day",),
) -> DataFrame:
    """One row per message: message_id, the carried columns, and `found`, empty if nothing matched.

    `boundary="word"` counts whole words and prefers longer aliases, with dictionaries of any size.
    `boundary="outer"` guards only the start of the first entity's aliases and the end of the last
    entity's; everything else also matches inside words, and the earlier alias wins. Its pattern is
    part of the plan, so the dictionary has to fit there. Matches do not overlap, case matters; a null
    text counts as empty. `message_id` and the carried columns identify a message.
    """
    keys = ["message_id", *carry]
    messages = messages.withColumn("body", F.coalesce("body", F.lit("")))
    if boundary == "word" and not _fits_in_row(aliases):
        table = aliases.table(messages.sparkSession) if isinstance(aliases, AliasBook) else unique_aliases(aliases)
        return _whole_words(messages, table, keys)
    book = AliasBook.of(aliases)
    hits = messages.select(
        *keys,
        F.regexp_extract_all("body", F.lit(book.pattern(boundary)), F.lit(0)).alias("hits"),
    )
    if len(book) > IN_ROW_ALIASES:
        return _named(hits, book.table(messages.sparkSession), keys)
    lookup = book.lookup()
    named = hits.select(*keys, F.transform("hits", lambda h: lookup[h]).alias("names"))
    return named.select(*keys, _tally("names").alias("found"))


def mention_sets(scanned: DataFrame) -> DataFrame:
    """Only the messages with at least one mention, by a generator for the reason given above."""
    others = [c for c in scanned.columns if c != "found"]
    return scanned.select(
        *others, F.explode(F.when(F.size("found") > 0, F.array("found"))).alias("found")
    )


def mention_rows(scanned: DataFrame) -> DataFrame:
    """Long form: one row per message and mentioned entity.

    `lead` marks the first row of each message, so that messages can be counted by summing it
    instead of by a distinct aggregate.
    """
    others = [c for c in scanned.columns if c != "found"]
    exploded = scanned.select(*others, F.posexplode(_unless_empty("found")).alias("position", "mention"))
    return exploded.select(
        *others, "mention.entity", "mention.n", (F.col("position") == 0).alias("lead")
    )


def mentioned_lists(sets: DataFrame, exclude: str | None = None) -> DataFrame:
    """Entities of each message, most mentioned first, ties by name. `exclude` leaves one entity out."""
    found = F.col("found")
    if exclude is not None:
        found = F.filter(found, lambda m: m["entity"] != exclude)
    ranked = F.sort_array(F.transform(found, lambda m: F.struct(-m["n"], m["entity"].alias("entity"))))
    others = [c for c in sets.columns if c != "found"]
    return sets.select(*others, F.transform(ranked, lambda m: m["entity"]).alias("entities"))


def count_whole_tokens(
    messages: DataFrame, aliases: DataFrame | AliasBook, carry: Sequence[str] = ("day",)
) -> DataFrame:
    """Mentions as exact tokens of the punctuation-free text, in long form.

    Every message with at least one token stays: one without a mention is a single row with a null
    entity and n = 0. A dictionary of any size works; a large one is joined instead of looked up.
    `message_id` and the carried columns identify a message.
    """
    keys = ["message_id", *carry]
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("entity"), F.lit(0).cast("bigint").alias("n")))
    if _fits_in_row(aliases):
        book = AliasBook.of(aliases)
        lookup = book.lookup()
        known = [alias for alias, _ in book.entries if text.is_plain_word(alias)]
        pattern = F.lit(text.scattered_token_pattern(known) if known else text.NOTHING)
        hits = messages.select(
            *keys,
            text.has_token(F.col("body")).alias("has_token"),
            F.regexp_extract_all("body", pattern, F.lit(0)).alias("hits"),
        )
        names = hits.select(
            *keys,
            "has_token",
            F.transform("hits", lambda h: lookup[text.without_punctuation(h)]).alias("names"),
        )
        rows = F.when(F.size("names") > 0, _tally("names")).when(F.col("has_token"), nothing)
        return names.select(*keys, F.inline(rows))
    table = aliases.table(messages.sparkSession) if isinstance(aliases, AliasBook) else unique_aliases(aliases)
    entries = _entries(table)
    if entries is None:
        tokens = messages.select(*keys, text.plain_tokens(F.col("body")).alias("hits"))
        found = _named(tokens.where(F.size("hits") > 0), table, keys)
    else:
        spoken = messages.where(text.has_token(F.col("body")))
        texts = F.transform("bodies", lambda b: F.struct(text.plain_tokens(b).alias("parts"), F.lit(True).alias("starts")))
        words = [(alias, entity, 1, alias) for alias, entity, _, _ in entries]
        found = _by_lookup(_gathered(spoken, keys).select(*keys, texts.alias("texts")), words, keys, False)
    return found.select(*keys, F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(nothing)))


def _fits_in_row(aliases: DataFrame | AliasBook) -> bool:
    if isinstance(aliases, AliasBook):
        return len(aliases) <= IN_ROW_ALIASES
    return len(aliases.select("alias").limit(IN_ROW_ALIASES + 1).collect()) <= IN_ROW_ALIASES
