"""Token ids in files: canonical length-limited Huffman codes, decoded by table in independent blocks.

Format. A file set is a folder of Parquet tables, so that any storage Spark writes to can hold it:

- `codes`: id, n (its count in all documents), length (bits of its code; canonical: codes of one length are
  consecutive numbers in order of id, shorter codes come first). This is all that is needed to decode.
- `segments`: start (ids of all documents before the segment), doc_ids and sizes (its documents in order, with
  the number of ids of each), checkpoints (the bit at which each block of BLOCK ids begins) and bits (the codes,
  first bit highest, with four bytes of zeros after the last). Segments are whole documents in ascending order.

Writing. Documents are dealt to shards by ranges of doc_id and encoded by the tokenizer once, in order. Counts of
ids are global. The code has the least total length among those of at most `limit` bits (package-merge).

Reading. All blocks of a segment are decoded side by side: a step looks up one id in every block, by
the next `limit` bits in a table of all their values.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder
from .common import stored
from .tokens import RANKS, TOKENIZER, tokenizer

END_ID = 0
LIMIT = 16
MOST_LIMIT = 24
BLOCK = 256
SEGMENT = 1 << 18
_PADDING = 4
_SEGMENTS = "start long, doc_ids array<long>, sizes array<long>, checkpoints array<long>, bits binary"


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code: least total for these counts (all positive) with none above `limit`.

    Package-merge: each level holds the symbols and pairs of the level below, by weight; how many symbols
    are among the cheapest 2n - 2 of a level says which get one more bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, []
    for depth in range(limit):
        if depth:
            even = len(level) // 2 * 2
            both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
            is_leaf = np.arange(len(both)) < n
            by_weight = np.argsort(both, kind="stable")
            level, is_leaf = both[by_weight], is_leaf[by_weight]
        else:
            is_leaf = np.ones(n, dtype=bool)
        kinds.append(is_leaf)
    lengths, taken = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        symbols = int(is_leaf[:taken].sum())
        lengths[order[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, symbols being in order of id."""
    codes, code, before = np.zeros(len(lengths), dtype=np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for length in np.unique(lengths):
        own = order[lengths[order] == length]
        code <<= int(length) - before
        codes[own] = code + np.arange(len(own))
        code, before = code + len(own), int(length)
    return codes


class Codebook:
    """ids (ascending) and the bits of each; encodes, and decodes by a table of all values of `limit` bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        self.limit = int(self.lengths.max(initial=1))
        self._coder = self._decoder = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, padded, and where the blocks of BLOCK ids begin."""
        if self._coder is None:
            code, length = (np.zeros(int(self.ids.max(initial=0)) + 1, dtype=np.uint64) for _ in range(2))
            code[self.ids], length[self.ids] = canonical_codes(self.lengths), self.lengths
            self._coder = code, length
        code, length = self._coder
        bits = length[ids]
        ends = np.cumsum(bits, dtype=np.uint64)
        begins = ends - bits
        word = (begins >> np.uint64(5)).astype(np.int64)
        placed = code[ids] << (np.uint64(64) - (begins & np.uint64(31)) - bits)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word, so one begins in each
        high = np.add.reduceat(placed >> np.uint64(32), first)
        low = np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        words = np.zeros(len(first) + 1, dtype=np.uint64)
        words[:-1] += high
        words[1:] += low
        size = -(-int(ends[-1]) // 8)
        data = words.astype(">u4").tobytes()[:size]
        return data + bytes(_PADDING), begins[::BLOCK].astype(np.int64)

    def decode(self, data: bytes, checkpoints: np.ndarray, number: int) -> np.ndarray:
        """The `number` ids of the blocks that begin at the given bits."""
        if self._decoder is None:
            order = np.lexsort((self.ids, self.lengths))
            spans = np.left_shift(1, self.limit - self.lengths[order])
            rest = (1 << self.limit) - int(spans.sum())  # a single id leaves half of the values unused
            self._decoder = (np.concatenate([np.repeat(self.ids[order], spans), np.zeros(rest, np.int64)]).astype(np.uint32),
                             np.concatenate([np.repeat(self.lengths[order], spans), np.ones(rest, np.int64)]).astype(np.int64))
        symbol, length = self._decoder
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        at = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # the 32 bits from each byte on
        last = len(at) - 1
        bit = np.array(checkpoints, dtype=np.int64)
        out = np.zeros((min(BLOCK, number), len(bit)), dtype=np.uint32)
        shift = 32 - self.limit
        for step in range(len(out)):
            window = (at[np.minimum(bit >> 3, last)] << (bit & 7).astype(np.uint32)) >> np.uint32(shift)
            out[step] = symbol[window]
            bit += length[window]
        return out.T.ravel()[:number] if len(out) == BLOCK else out.T.ravel()


# ---------------------------------------------------------------- writing


def ordered_ids(docs: DataFrame, path: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """shard, at (ids before it in the shard), doc_id, n, ids (little-endian, 32 bits) of every row of `docs`, stored.

    Shards are ranges of doc_id, nulls last; rows of one doc_id are spread by their text and place, so that an
    id which many rows share fills no task. A file holds a shard in order.
    """

    def encode(batches):
        end, shard, at = np.array([END_ID], dtype="<u4").tobytes(), None, 0
        for batch in batches:
            ids, places, data = tokenizer(path, ranks).ids, [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != shard:
                    shard, at = own, 0
                data.append(ids(text or "") + end)
                places.append(at)
                at += len(data[-1]) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array([len(d) // 4 for d in data], pa.int64()),
                 pa.array(data, pa.binary())],
                ["shard", "at", "doc_id", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("row").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    return stored(numbered.mapInArrow(encode, "shard int, at long, doc_id long, n long, ids binary"))


def _counted(held: DataFrame) -> pd.DataFrame:
    """id, n over all documents; at most one row for each id of the vocabulary."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            own = np.bincount(np.frombuffer(data, dtype="<u4"), minlength=len(total))
            own[: len(total)] += total
            total = own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = held.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counted.orderBy("id").toPandas()


def _segments(held: DataFrame, offsets: DataFrame, codebook: Codebook) -> DataFrame:
    shared = held.sparkSession.sparkContext.broadcast(codebook)  # at most one row for each id of the vocabulary

    def encode(batches):
        docs, sizes, data, start, upto = [], [], [], None, None

        def segment():
            bits, checkpoints = shared.value.encode(np.frombuffer(b"".join(data), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([checkpoints], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["start", "doc_ids", "sizes", "checkpoints", "bits"],
            )

        for batch in batches:
            for place, doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if docs and (place != upto or upto - start >= SEGMENT):
                    yield segment()
                    docs, sizes, data = [], [], []
                if not docs:
                    start = place
                docs.append(doc)
                sizes.append(n)
                data.append(ids)
                upto = place + n
        if docs:
            yield segment()

    placed = held.join(offsets, "shard").select((F.col("before") + F.col("at")).alias("start"), "doc_id", "n", "ids")
    return placed.mapInArrow(encode, _SEGMENTS)


def write(docs: DataFrame, folder: str, limit: int = LIMIT, path: str = TOKENIZER, ranks: str | None = RANKS) -> None:
    """Write the ids of all rows of `docs` (doc_id, text; more columns are ignored), with the end id after each.

    A null text is empty. Documents stand in ascending order of doc_id, nulls last; repeated rows are written
    each, rows of one doc_id in order of a hash of their text. An empty table gives empty files. Where more ids occur than `limit` bits can
    tell apart, codes get as many bits as that takes, at most MOST_LIMIT.
    """
    spark = docs.sparkSession
    held = ordered_ids(docs, path, ranks)
    counts = _counted(held)
    bits = max(limit, max(1, len(counts) - 1).bit_length())
    if bits > MOST_LIMIT:
        raise ValueError(f"codes of {bits} bits are longer than the decoding table allows")
    lengths = code_lengths(counts["n"].to_numpy(), bits)
    codebook = Codebook(counts["id"].to_numpy(), lengths)
    table = pa.table({"id": pa.array(codebook.ids), "n": pa.array(counts["n"].to_numpy(), pa.int64()), "length": pa.array(lengths, pa.int32())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/codes")
    sums = sorted((r["shard"], r["n"]) for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # a row for each task
    before = np.cumsum([0, *(n for _, n in sums)])[:-1] if sums else []
    offsets = spark.createDataFrame(pa.table({"shard": pa.array([s for s, _ in sums], pa.int32()), "before": pa.array(before, pa.int64())}))
    _segments(held, F.broadcast(offsets), codebook).write.parquet(f"{folder}/segments")


# ---------------------------------------------------------------- reading


def open_codebook(spark: SparkSession, folder: str) -> Codebook:
    rows = spark.read.parquet(f"{folder}/codes").orderBy("id").toPandas()  # at most one row for each id of the vocabulary
    return Codebook(rows["id"].to_numpy(), rows["length"].to_numpy())


def _read(spark: SparkSession, folder: str, columns: dict[str, str], of) -> DataFrame:
    """Rows of documents from the files; `of(ids)` gives the further columns of one document."""
    shared = spark.sparkContext.broadcast(open_codebook(spark, folder))
    kind = ", ".join(["doc_id long, start long, n_tokens long", *(f"{c} {t}" for c, t in columns.items())])

    def decode(batches):
        for batch in batches:
            for start, docs, sizes, checkpoints, bits in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ends = np.cumsum(sizes)
                ids = shared.value.decode(bits, np.array(checkpoints), int(ends[-1])).astype("<u4")
                found = [of(ids[e - n : e]) for n, e in zip(sizes, ends.tolist())]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "doc_id": pd.array(docs, dtype="Int64"), "start": start + ends - np.array(sizes), "n_tokens": sizes,
                    **{c: [f[i] for f in found] for i, c in enumerate(columns)},
                }), preserve_index=False)

    names = ["start", "doc_ids", "sizes", "checkpoints", "bits"]
    return spark.read.schema(_SEGMENTS).parquet(f"{folder}/segments").select(*names).mapInArrow(decode, kind)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (with the end id) of every document in the files."""
    return _read(spark, folder, {"ids": "array<int>"}, lambda ids: (ids.astype(np.int32),))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers) of every document."""
    return _read(spark, folder, {"ids_crc32": "long"}, lambda ids: (zlib.crc32(ids.tobytes()),))


def round_trip(docs: DataFrame) -> DataFrame:
    """Write `docs` to a new folder beside the session's checkpoints, and read the digests back."""
    folder = f"{checkpoint_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder)
    return read_digests(docs.sparkSession, folder)
