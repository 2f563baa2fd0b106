"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most 2h bits share a word that is within h bits of both. So every
distinct fingerprint emits all words of its ball of radius h; fingerprints that meet in a word are
candidates, and their distance is verified.

A ball is small (65 words for h = 1) and fingerprints are made distinct first, so a word gathers no
more fingerprints than a ball has words, whatever the number of copies. All that meet in a word are
within 2h of each other, so linking neighbours in order joins them all without forming all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import connected_components, stored

SHINGLE = 3
RADIUS = 2
SEED = 42
_BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; zero without a word.

    Words are runs of other than ASCII white space, with A-Z in lower case. A shorter text is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for start in range(0, total, _BLOCK):
        stop = min(start + _BLOCK, total)
        columns = [words[start + i : stop + i] for i in range(shingle)]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*columns)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprint(shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprint("text")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row."""
    return docs.select("doc_id", _fingerprint(shingle).alias("fp"))


def _masks(bits: int) -> list[int]:
    values = [sum(1 << b for b in chosen) for n in range(bits + 1) for chosen in combinations(range(64), n)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at `radius` or fewer differing bits that connect all such pairs.

    `fps` has one column `fp` of distinct values; `radius` is even.
    """
    if radius % 2:
        raise ValueError("the radius must be even: a ball covers half of it")
    masks = F.array(*[F.lit(m) for m in _masks(radius // 2)])
    balls = fps.select("fp", F.explode(masks).alias("mask")).select(F.expr("fp ^ mask").alias("word"), "fp")
    before = F.lag("fp").over(Window.partitionBy("word").orderBy("fp"))
    met = balls.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return met.distinct().where(F.expr(f"bit_count(a ^ b) <= {radius}"))


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """fp, first (its smallest doc_id), root (one fingerprint of its component), component_id; stored.

    `rows` has doc_id, fp.
    """
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(firsts.select("fp"), radius))
    named = firsts.join(roots, firsts.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = stored(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(named.join(stored(smallest), "root").select("fp", "first", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked, over any number of links).

    One row per row of `docs` (doc_id, text; more columns are ignored). A null text counts as empty;
    texts without a word have fingerprint zero and are linked like any other. Repeated rows stay. A null
    doc_id is never the smallest unless its component has no other. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle))
    classes = _classes(rows, radius).select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` for each component: that of the smallest doc_id; its columns unchanged.

    Of a component's rows that share this doc_id the smallest by its values stays; other components may have rows
    with the same doc_id, and each keeps its own. A row without a doc_id stays only where its component has no other.
    An empty table gives no rows.

    Fingerprints are computed once and stored beside the id and a 128-bit hash of the row. What stays is
    chosen on these narrow rows; texts are shuffled once, to meet the keys that were chosen. Whole rows are
    compared only in components whose smallest doc_id has several rows.
    """
    keyed = docs.select(
        "doc_id", F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit(SEED), *docs.columns).alias("h2"),
        F.struct(*docs.columns).alias("row"), "text",
    )
    key = ["doc_id", "h1", "h2"]
    rows = stored(keyed.select(*key, _fingerprint().alias("fp")))
    classes = _classes(rows.select("doc_id", "fp"), radius).where("first <=> component_id")
    firsts = classes.select(F.col("fp").alias("of"), "root", "component_id")
    met = (F.col("fp") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    able = stored(rows.join(firsts, met).groupBy("root", *key).agg(F.count("*").alias("n")))
    roots = able.groupBy("root").agg((F.sum("n") == 1).alias("alone"), F.first(F.struct(*key)).alias("key"))
    chosen = stored(roots.where("alone").select("root", "key.*"))
    shared = stored(roots.where("NOT alone").select("root").join(able.select("root", *key), "root"))

    def whole(keys: DataFrame) -> DataFrame:
        names = keys.withColumnsRenamed({"doc_id": "id", "h1": "k1", "h2": "k2"})
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("id"))
        return keyed.select(*key, "row").join(names, same).select("root", "row")

    least = whole(shared).groupBy("root").agg(F.min("row").alias("row"))
    return whole(chosen.hint("shuffle_hash")).unionByName(least).select("row.*")
