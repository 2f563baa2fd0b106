"""Ranked lexical search by deduplicating bags of words.

1. Documents are restricted to the vocabulary of the items: a document becomes its bag, the ids and counts of the
   vocabulary's terms in it, beside its number of terms.
2. A score depends on a document only by its bag and its length factor m. Documents are hashed by both, and
   classes of equal (bag, m) are formed by comparing the bags themselves; where two classes share a hash,
   their members are told apart by their bags.
3. Each class is scored once, in blocks, against all items of a block; a task keeps the best classes only.
4. The best classes are expanded to their members by ascending doc_id. Every class that stands before another
   (higher score, or equal score and smaller first member) has a member before all of the other's, so the
   k best classes hold the k best documents, and of a class its k first members are enough.

Items are dealt in blocks of at most about BLOCK_TERMS terms; a block is what is broadcast. A class of a third
of all documents is one row, folded before the shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

K = 50
BLOCK_TERMS = 200_000
TERM_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in TERM_BYTES else 32 for c in range(256))
_SCALE, _WHOLE = 10**9, 1000
_EXPANDED = 1 << 19


def terms(text: str | None) -> list[bytes]:
    """The runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each distinct pair once; rows of one item_id are one item, null is one, too."""

    def split(batches):
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(terms(text))
                ids += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, with repeats), terms and tfs (those of the vocabulary, by id) of every row of `docs`."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS entries

    def tally(batches):
        number = known.value
        for batch in batches:
            sizes, ends, ids, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                own = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                sizes.append(len(found))
                ids += [i for i, _ in own]
                counts += [c for _, c in own]
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tally, "doc_id long, n long, terms array<int>, tfs array<int>")


def _hash(bits: int) -> Column:
    """A hash of bag and m. Fewer bits only serve to test classes that share a hash."""
    return F.shiftrightunsigned(F.xxhash64("terms", "tfs", "m"), 64 - bits) if bits < 64 else F.xxhash64("terms", "tfs", "m")


def classes_of(factored: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Classes (h, twin, m, terms, tfs, first) and members (h, twin, doc_id) of rows doc_id, m, terms, tfs; both stored.

    A class is (h, twin): twin tells classes of one hash apart and is 0 where a hash has one class. `first` is
    the smallest doc_id, null where no member has one.
    """
    hashed = factored.withColumn("h", _hash(bits))
    folded = stored(hashed.groupBy("h", "m", "terms", "tfs").agg(F.min("doc_id").alias("first")))  # compares whole bags
    twins = stored(folded.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    classes = folded.withColumn("twin", F.lit(0))
    if twins.isEmpty():
        return classes, stored(hashed.select("h", F.lit(0).alias("twin"), "doc_id"))
    place = F.row_number().over(Window.partitionBy("h").orderBy("m", "terms", "tfs")) - 1
    told = stored(folded.join(twins, "h").withColumn("twin", place))
    several = hashed.join(told.drop("first"), ["h", "m", "terms", "tfs"]).select("h", "twin", "doc_id")
    alone = hashed.join(twins, "h", "left_anti").select("h", F.lit(0).alias("twin"), "doc_id")
    return classes.join(twins, "h", "left_anti").unionByName(told), stored(alone.unionByName(several))


class _Best:
    """The best classes of each item so far; `floors` are the scores that a further class must reach."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floors = k, np.ones(items, dtype=np.int64)
        self.kept = [np.zeros(0, dtype=np.int64) for _ in range(6)]  # item, score, no first, first, h, twin
        self.waiting: list[list[np.ndarray]] = []
        self.number = 0

    def add(self, found: list[np.ndarray]) -> None:
        self.waiting.append(found)
        self.number += len(found[0])
        if self.number > 4 * self.k * len(self.floors) + (1 << 16):
            self.fold()

    def fold(self) -> None:
        item, score, no_first, first, *_ = columns = [np.concatenate(c) for c in zip(self.kept, *self.waiting)]
        order = np.lexsort((first, no_first, -score, item))
        ordered = item[order]
        rank = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        full = order[rank == self.k - 1]
        self.floors[item[full]] = np.maximum(self.floors[item[full]], score[full])
        self.kept, self.waiting, self.number = [c[order[rank < self.k]] for c in columns], [], 0


def best_classes(classes: DataFrame, items: list[list[int]], weights: list[int], k: int) -> DataFrame:
    """item (its place in `items`), score, first, h, twin: the k best classes of each item that a task has seen."""
    size, most_terms = len(weights), max(map(len, items), default=0)
    owners = [(t, i) for i, own in enumerate(items) for t in own]
    owners.sort()
    starts = np.searchsorted(np.array([t for t, _ in owners]), np.arange(size + 1))
    index = (starts, np.array([i for _, i in owners], dtype=np.int64), np.array(weights, dtype=np.int64))
    shared = classes.sparkSession.sparkContext.broadcast(index)
    number = len(items)
    exact = most_terms * max(weights, default=0) * (_SCALE // _WHOLE) < 1 << 53

    def scored(ids: np.ndarray, tfs: np.ndarray, of: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
        starts, owner, weight = shared.value
        gains = weight[ids] * ((_SCALE * tfs) // (_WHOLE * tfs + 20 * m[of]))
        width = starts[ids + 1] - starts[ids]
        within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        cell = np.repeat(of, width) * number + owner[np.repeat(starts[ids], width) + within]
        if exact:  # all sums are whole numbers that a double holds
            flat = np.bincount(cell, weights=np.repeat(gains, width), minlength=rows * number).astype(np.int64)
        else:
            flat = np.zeros(rows * number, dtype=np.int64)
            np.add.at(flat, cell, np.repeat(gains, width))
        return flat.reshape(rows, number)

    def search(batches):
        starts = shared.value[0]
        best = _Best(number, k)
        for batch in batches:
            h, twin, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            nulls = batch.column(3).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            lists = batch.column(4)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = lists.flatten().to_numpy().astype(np.int64)
            tfs = batch.column(5).flatten().to_numpy().astype(np.int64)
            cost = np.concatenate([[0], np.cumsum(starts[ids + 1] - starts[ids])])[ends] + np.arange(len(ends)) * number
            low = 0
            while low < len(h):
                high = max(low + 1, int(np.searchsorted(cost, cost[low] + _EXPANDED, side="right")) - 1)
                part = slice(ends[low], ends[high])
                of = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
                scores = scored(ids[part], tfs[part], of, m[low:high], high - low)
                row, item = np.nonzero(scores >= best.floors)
                place = row + low
                best.add([item, scores[row, item], nulls[place], first[place], h[place], twin[place]])
                low = high
        best.fold()
        item, score, no_first, first, h, twin = best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(score), pa.array(first, mask=no_first.astype(bool)), pa.array(h), pa.array(twin.astype(np.int32))],
            ["item", "score", "first", "h", "twin"],
        )

    columns = classes.select("h", "twin", "m", "first", "terms", "tfs")
    return columns.mapInArrow(search, "item long, score long, first long, h long, twin int")


def _search_block(docs: DataFrame, block: DataFrame, k: int, bits: int) -> DataFrame | None:
    rows = block.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()  # one block of items
    if not rows:
        return None
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    items = [[vocabulary[bytes(t)] for t in r["terms"]] for r in rows]
    held = stored(bags(docs, vocabulary))
    counted, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not counted:
        return None
    df = {r["term"]: r["df"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = [math.floor(1000 * math.log((2 * counted + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    m = F.lit(100 - 50) + F.expr(f"(50 * n * {counted}L) div {length}L")
    classes, members = classes_of(held.where("size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs"), bits)
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())
    leading = best_classes(classes, items, weights, k).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
    leading = stored(leading.drop("place", "first"))
    wanted = members.join(leading.select("h", "twin").distinct(), ["h", "twin"])
    in_class = Window.partitionBy("h", "twin").orderBy(F.col("doc_id").asc_nulls_last())
    firsts = wanted.withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= k).drop("place")
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = leading.join(firsts, ["h", "twin"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({
        "item": pa.array(range(len(rows)), pa.int64()), "item_id": pa.array([r["item_id"] for r in rows], pa.int64()),
    }))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, bits: int = 64) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k rows of `docs` (doc_id, text) with the highest score above 0 for
    each item of `items` (item_id, text); more columns on either side are ignored.

    Equal scores are ranked by ascending doc_id, nulls last; repeated rows are ranked each. A null or empty text has
    no terms: such a document is never found and counts in no statistic, such an item has no rows. Rows of one
    item_id are one item with the terms of all. Empty tables on either side give no rows.
    """
    pairs = stored(_item_terms(items))
    blocks = max(1, -(-pairs.count() // block_terms))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = [_search_block(docs, dealt.where(F.col("block") == b), k, bits) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def oracle_sql(k: int = K) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH words AS (SELECT doc_id, {split} AS terms FROM documents),
    sizes AS (SELECT doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
    tallied AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM words) GROUP BY doc_id, term),
    asked AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
    weighed AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tallied, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
    factored AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // length AS m FROM sizes, totals),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM asked JOIN tallied USING (term) JOIN weighed USING (term) JOIN factored USING (doc_id)
        GROUP BY item_id, doc_id),
    ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
