"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put in classes of like length, and classes are dealt in chunks of bounded size. The longest class
gives every query a first k-th best score. A class can then hold a better vector only if its greatest
length times the query's reaches that score, so queries skip the classes that cannot. In a chunk the score
turns into a local cosine threshold. Where this is high, vectors are pruned by their coordinates: a vector
whose share in one of the query's largest coordinates is x has cosine a x + sqrt((1 - a^2)(1 - x^2)) at most.
Where it is low, they are pruned by length. What is left is verified by integer products.

Queries are dealt in blocks, so a task holds one chunk and one block, whatever the number of either. After the longest
class the blocks are ranges of the length that a vector needs to reach its query's score, so the blocks that a class can
still serve are the first ones, and its vectors are sent to those alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import row_salt, stored

K = 20
SCALE = 64
CLASSES = 32
LEAST_CLASS = 256
CHUNK_ROWS = 16384
BLOCK_ROWS = 8192
COORDINATE_COSINE = 0.4
FOCUS = 3
_SLACK = 1e-9
_OUT = "query_id long, vec_id long, score long, copies long"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (floor of `scale` times each component), norm, copies: one row for each vec_id and vector, with the
    number of rows that it stands for.

    Rows without an id, without a vector, or with a null or non-finite component are left out.
    """
    broken = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('Infinity'))"
    whole = embeddings.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT {broken}")
    scaled = f"transform(embedding, x -> floor({scale} * CAST(x AS DOUBLE)))"
    vectors = whole.select(F.col("vec_id").cast("long"), F.expr(scaled).alias("vector"))
    vectors = vectors.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    norm = "sqrt(aggregate(vector, double(0), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
    return vectors.select("vec_id", "vector", F.expr(norm).alias("norm"), "copies")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, in floats where all sums are exact there; beyond a long they saturate."""
    most = [int(np.abs(m).max(initial=0)) if m.size else 0 for m in (a, b)]
    reach = most[0] * most[1] * a.shape[1]
    if reach < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if reach < 1 << 63:
        return a @ b.T
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), ends.min, ends.max).astype(np.int64)


def _best(query_ids, floors, ids, copies, scores, k) -> list[tuple[int, int, int, int]]:
    """Of each query's scores the k best at its floor or above; its own id takes no part."""
    out = []
    for row, (query, floor) in enumerate(zip(query_ids, floors)):
        able = np.flatnonzero((scores[row] >= floor) & (ids != query))
        if len(able) > k:
            kth = np.partition(scores[row, able], len(able) - k)[len(able) - k]
            able = able[scores[row, able] >= kth]
        able = able[np.lexsort((ids[able], -scores[row, able]))][:k]
        out += [(query, int(ids[i]), int(scores[row, i]), int(copies[i])) for i in able]
    return out


def search_chunk(queries: pd.DataFrame, chunk: pd.DataFrame, k: int) -> list[tuple[int, int, int, int]]:
    """(query, vector, score, copies): what a chunk adds to the k best of each query above its floor (null: none)."""
    width = max(map(len, [*queries["vector"], *chunk["vector"]]))
    chunk = chunk.sort_values(["norm", "vec_id"], ascending=[False, True])
    vectors, ids, norms = _matrix(chunk["vector"], width), chunk["vec_id"].to_numpy(), chunk["norm"].to_numpy()
    copies = chunk["copies"].to_numpy()
    own, lengths = _matrix(queries["vector"], width), queries["norm"].to_numpy()
    names = queries["vec_id"].to_numpy()
    floors = queries["floor"].to_numpy(dtype=float, na_value=-np.inf)
    reach = lengths * norms[0]
    cosine = np.where(reach > 0, floors / np.where(reach > 0, reach, 1), -np.inf)
    out = []
    by_length = np.flatnonzero(cosine < COORDINATE_COSINE)
    for start in range(0, len(by_length), 256):
        part = by_length[start : start + 256]
        able = np.where(lengths[part] > 0, floors[part] / np.where(lengths[part] > 0, lengths[part], 1), -np.inf)
        upto = int(np.searchsorted(-norms, -(able.min() * (1 - _SLACK) - _SLACK), side="right")) if able.min() > 0 else len(ids)
        if upto:
            out += _best(names[part], floors[part], ids[:upto], copies[:upto], _products(own[part], vectors[:upto]), k)
    units = None
    for q in np.flatnonzero((cosine >= COORDINATE_COSINE) & (cosine <= 1 + _SLACK)):
        if units is None:
            units = vectors / np.where(norms > 0, norms, 1)[:, None]
        direction = own[q] / lengths[q]
        local = floors[q] / (lengths[q] * np.where(norms > 0, norms, np.nan)) - _SLACK
        able = np.arange(len(ids))
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            x, a = units[able, f], direction[f]
            most = a * x + np.sqrt(np.clip((1 - a * a) * (1 - x * x), 0, None))
            able = able[most >= local[able]]
        if len(able):
            out += _best(names[q : q + 1], floors[q : q + 1], ids[able], copies[able], _products(own[q : q + 1], vectors[able]), k)
    return out


def _search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Both sides have a chunk and a block; groups without one of the sides give nothing."""

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = search_chunk(left, right, k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "copies"], dtype=np.int64)

    keys = ("class", "chunk", "block")
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(group, _OUT)


def by_need(floored: DataFrame, blocks: int) -> DataFrame:
    """Queries (vec_id, norm, floor, ...) with `need`, the length below which no vector reaches the floor (null: any may), and
    `block`, from 0, which are ranges of it, of like size. Equal needs are split by the query's id."""
    need = F.when(F.col("norm") > 0, (F.col("floor") - _SLACK) / (F.col("norm") * (1 + _SLACK)))
    dealt = floored.withColumn("need", need).repartitionByRange(blocks, F.col("need").asc_nulls_first(), F.xxhash64("vec_id"))
    return dealt.withColumn("block", F.spark_partition_id())


def blocks_served(floored: DataFrame, lengths: dict[int, float]) -> dict[int, int]:
    """For each class, by its greatest length, how many of the first blocks hold a query that it can serve."""
    served = [F.max(F.when(F.col("need").isNull() | (F.col("need") <= most), F.col("block"))).alias(str(c)) for c, most in lengths.items()]
    last = floored.agg(*served).first()  # one number for each class
    return {c: 0 if last[str(c)] is None else last[str(c)] + 1 for c in lengths}


def _sent(chunked: DataFrame, served: dict[int, int]) -> DataFrame:
    """The vectors of the given classes, once for each of the first blocks that their class serves."""
    able = {c: n for c, n in served.items() if n > 0}
    number = F.coalesce(*[F.when(F.col("class") == c, F.lit(n)) for c, n in able.items()], F.lit(0))
    sent = chunked.where(F.col("class").isin(list(able)))
    return sent.withColumn("block", F.explode(F.when(number > 0, F.sequence(F.lit(0), number - 1))))


def top_k(embeddings: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `is_query` selects, the k other rows with the
    highest inner products, ties to the smaller vec_id; all others if there are fewer.

    `embeddings` has vec_id and embedding (array of numbers); more columns are ignored. See
    `integer_vectors` for rows that take no part; shorter vectors count as filled up with zeros, and rows
    that share the query's vec_id are its own. Repeated rows are candidates each. Scores beyond a long saturate. An empty table gives no rows.
    """
    vectors = stored(integer_vectors(embeddings, scale))
    queries = stored(vectors.where(is_query))
    total, asked = vectors.count(), queries.count()
    classes = max(1, min(CLASSES, total // LEAST_CLASS))
    shares = [1 - i / classes for i in range(1, classes)]
    bounds = vectors.approxQuantile("norm", shares, 0.002) if shares and total else []
    number = sum((F.col("norm") < b).cast("int") for b in bounds) if bounds else F.lit(0)
    classed = vectors.withColumn("class", number)
    measured = {r["class"]: r for r in classed.groupBy("class").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    if not measured:
        measured = {0: {"n": 0, "most": 0.0}}
    chunks = [-(-measured[c]["n"] // CHUNK_ROWS) if c in measured else 1 for c in range(classes)]
    blocks = max(1, -(-asked // BLOCK_ROWS))
    salt = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*map(F.lit, chunks)), F.col("class") + 1))
    chunked = classed.withColumn("chunk", salt)
    longest = min(measured)

    def per_chunk(frame: DataFrame) -> DataFrame:
        wide = F.sequence(F.lit(0).cast("long"), F.element_at(F.array(*map(F.lit, chunks)), F.col("class") + 1) - F.lit(1).cast("long"))
        return frame.withColumn("chunk", F.explode(wide))

    asked_first = queries.withColumns({
        "block": row_salt(blocks, "vec_id").cast("int"), "class": F.lit(longest), "floor": F.lit(None).cast("double")})
    first = stored(_search(per_chunk(asked_first), _sent(chunked, {longest: blocks}), k))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    floors = kth.select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("floor"))
    rest = {c: measured[c]["most"] for c in sorted(measured) if c != longest}
    found = first
    if rest:
        floored = stored(by_need(queries.join(floors, F.col("vec_id") == F.col("of"), "left").drop("of"), blocks))
        lengths = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(most).alias("most")) for c, most in rest.items()])
        able = F.filter(lengths, lambda c: F.col("need").isNull() | (c["most"] >= F.col("need")))
        again = floored.withColumn("able", F.explode(able)).withColumn("class", F.col("able.class")).drop("able", "need")
        found = first.union(_search(per_chunk(again), _sent(chunked, blocks_served(floored, rest)), k))
    leading = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).drop("rank")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long"))))
    single = leading.select("query_id", "vec_id", "score", each.alias("copy"))
    ranked = single.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
