"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources get targets in words: shares of a budget by weight, none above a multiple of its own size.
2. A seeded hash deals the rows of each source to blocks, so the order of the blocks is a random
   permutation. Whole blocks are drawn, in each further pass over a source once more, until the words
   drawn come nearest the target. This fixes the exact number of block draws of every source.
3. The tree divides these quotas among output shards: at each node the left half's share is one draw of
   the multivariate hypergeometric distribution, so shards are full and differ from the mixture only as
   random draws without replacement do. A shard then owns a range of each source's permuted blocks,
   disjoint from those of other shards.
4. Rows are shuffled within their shard by a seeded hash.

The numbers of shards and blocks follow from the words, so a shard, which is one task's, has about SHARD_WORDS words at any
size of the corpus. A source's rows are never gathered: a group has its blocks, as numbers, and rows meet their block by
(source, block), so a source that holds a third of all rows is spread over all its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BLOCKS = 1024  # of each source, at least
SHARD_WORDS = 1 << 22
SHARD_BLOCKS = 16  # of each source, for each shard
FANOUT = 16
SWAPS = 8
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(text: str = "text") -> Column:
    """Runs of other than ASCII white space; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target: `budget` times all words, shared by weight, at most `most` times a source's own.

    `sizes` has a row per source. What a full source can't take is shared by the others, by weight. Sources
    fill up in the order of what they can take per weight, so the full ones are a prefix of that order.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    most_words = F.col("source_size") * float(most)
    left = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum(most_words).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = weighed.select("*", most_words.alias("most_words"), left.alias("left"), open_weight.alias("open_weight"))
    full = F.col("left") * F.col("weight") >= F.col("most_words") * F.col("open_weight")
    share = F.max(F.when(~full, F.struct(F.col("open_weight").alias("by"), (F.col("left") / F.col("open_weight")).alias("level"))))
    return leveled.select(
        "source", "source_size",
        F.when(full, F.col("most_words")).otherwise(F.col("weight") * share.over(everything)["level"]).alias("target"),
    )


def _draw(blocks: pd.DataFrame) -> pd.DataFrame:
    """How often each block of one source is drawn, so that the words come nearest the target."""
    blocks = blocks.sort_values("block")
    words, target = blocks["words"].to_numpy(), float(blocks["target"].iloc[0])
    whole = int(target // max(1, words.sum())) if words.sum() else 0
    copies, rest = np.full(len(blocks), whole), target - whole * words.sum()
    for i, n in enumerate(words):
        if 0 < n <= rest:
            copies[i] += 1
            rest -= n
    undrawn = [i for i in range(len(words)) if copies[i] == whole and 0 < words[i] < 2 * rest]
    if undrawn:
        chosen = min(undrawn, key=lambda i: abs(words[i] - rest))
        copies[chosen] += 1
        rest -= words[chosen]
    for _ in range(SWAPS):
        drawn, left = np.flatnonzero(copies > whole), np.flatnonzero(copies == whole)
        if not len(drawn) or not len(left):
            break
        left = left[np.argsort(words[left], kind="stable")]
        wanted = rest + words[drawn]  # of each drawn block's place
        after = np.searchsorted(words[left], wanted)
        near = np.clip(np.stack([after - 1, after]), 0, len(left) - 1)
        gaps = np.abs(wanted - words[left[near]])
        side, j = np.unravel_index(gaps.argmin(), gaps.shape)
        if gaps[side, j] >= abs(rest):
            break
        i = near[side, j]
        rest -= words[left[i]] - words[drawn[j]]
        copies[left[i]], copies[drawn[j]] = whole + 1, whole
    return blocks[["source", "block"]].assign(copies=copies)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """source, shard, n: the block draws of each source in each shard; `quotas` has source, n.

    A level of the tree is a shuffle by node; a node's rows are its sources. Every task divides its node in
    up to FANOUT parts, by halves.
    """

    def divide(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("source", na_position="last", kind="stable")
        parts = [(int(node["first"].iloc[0]), int(node["span"].iloc[0]), node["n"].to_numpy())]
        for _ in range(FANOUT.bit_length() - 1):
            halves = []
            for first, span, counts in parts:
                if span == 1:
                    halves.append((first, span, counts))
                    continue
                rng = np.random.default_rng((seed, first, span))
                total = int(counts.sum())
                left = rng.multivariate_hypergeometric(counts, total * (span // 2) // span, method="marginals")
                halves += [(first, span // 2, left), (first + span // 2, span - span // 2, counts - left)]
            parts = halves
        return pd.concat(
            pd.DataFrame({"source": node["source"], "first": first, "span": span, "n": counts})[counts > 0]
            for first, span, counts in parts
        )

    nodes = quotas.where("n > 0").select("source", F.lit(0).alias("first"), F.lit(shards).alias("span"), F.col("n").cast("long"))
    span = shards
    while span > 1:
        nodes = nodes.groupBy("first", "span").applyInPandas(divide, "source string, first int, span int, n long")
        span = -(-span // FANOUT)
    return nodes.select("source", F.col("first").alias("shard"), "n")


def block_of(blocks: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(blocks)).cast("int")


def draws(
    sized: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = SEED, shard_words: int = SHARD_WORDS, **targets
) -> tuple[DataFrame, int, int]:
    """source, block, source_size, target, shards (one for each time the block is drawn); and the numbers of blocks and shards.

    `sized` has doc_id, source, size for every row of the corpus; it is read twice, so it should be stored. Where they are not
    given, there are so many shards that each has about `shard_words` words, and SHARD_BLOCKS blocks for each of them.
    """
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **targets))
    if shards is None:
        words = sources.agg(F.sum("target")).first()[0]
        shards = max(1, -(-int(words or 0) // shard_words))
    blocks = blocks or max(BLOCKS, SHARD_BLOCKS * shards)
    counted = stored(sized.groupBy("source", block_of(blocks, seed).alias("block")).agg(F.sum("size").alias("words")))
    named = sources.withColumnRenamed("source", "name")
    aimed = counted.join(named, counted.source.eqNullSafe(named.name))
    drawn = stored(aimed.groupBy("source").applyInPandas(_draw, "source string, block int, copies int"))
    quotas = drawn.groupBy("source").agg(F.sum("copies").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    split = split_quotas(quotas, shards, seed).select(F.col("source").alias("owner"), "shard", "n", ends.alias("end")).where("n > 0")
    owned_places = split.select("owner", "shard", F.explode(F.sequence(F.col("end") - F.col("n") + 1, "end")).alias("at"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "copy"), "block", "copy")
    single = drawn.where("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    ranked = single.withColumn("place", F.row_number().over(permuted).cast("long"))
    owned = (
        ranked.join(owned_places, F.col("source").eqNullSafe(F.col("owner")) & (F.col("place") == F.col("at")))
        .groupBy(F.col("source").alias("of"), F.col("block").alias("no")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    )
    joined = aimed.join(owned, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("no")), "left")
    found = joined.select(
        "source", "block", "source_size", "target", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")
    )
    return stored(found), blocks, shards


def _sized(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_in_words().alias("size")))


def allocate(docs: DataFrame, **layout) -> DataFrame:
    """doc_id, size, source_size, target and shards for every row of `docs` (doc_id, source, text).

    `shards` lists the output shards that get the row, once for each time it is taken. Null texts have
    size 0 and are taken with their block; null sources are one source, last in order; rows with a
    null doc_id share a block. Repeated rows count and are taken each. More columns are ignored. An empty table gives
    no rows. `layout` goes to `draws`.
    """
    sized = _sized(docs)
    drawn, blocks, _ = draws(sized, **layout)
    placed = sized.withColumn("block", block_of(blocks, layout.get("seed", SEED)))
    named = drawn.withColumnsRenamed({"source": "of", "block": "no"})
    met = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("no"))
    return placed.join(named, met).select("doc_id", "size", "source_size", "target", "shards")


def mix(docs: DataFrame, **layout) -> DataFrame:
    """The mixture: rows of `docs` with their columns as `row`, as often as they are taken, by shard, shuffled there.

    Each shard is one task's. Null, empty and repeated rows are taken as in `allocate`; an empty table gives no rows.
    """
    seed = layout.get("seed", SEED)
    drawn, blocks, shards = draws(_sized(docs), **layout)
    key = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"),
                      F.col("source").cast("string"), block_of(blocks, seed).alias("block"))
    named = drawn.where(F.size("shards") > 0).withColumnsRenamed({"source": "of", "block": "no"})
    met = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("no"))
    taken = key.join(named, met).select("row", "doc_id", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "copy")
    return taken.repartitionById(shards, "shard").sortWithinPartitions("shard", order).select("row", "shard")
