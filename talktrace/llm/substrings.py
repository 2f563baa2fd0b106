"""Removal of long byte strings that occur in an earlier document, by a logarithmic family of sorted hash indexes.

A string of LENGTH bytes contains, wherever it occurs, the same anchor: its K-byte word of least hash. So only
runs at anchors, one in about 17 bytes, are indexed. Consecutive strings with the same anchor form a run; an
index entry is a run's anchor word (48 bits) and content (64 bits) as hashes, and the smallest doc_id that has it.
Many contents share one anchor word at the ends of a copied passage, so the content's bits alone must tell them apart.

1. Tasks sort the entries of a batch of documents by hash, and resolve those that repeat in the batch.
   The arrays are cut in key ranges and shuffled.
2. For each key range, arrays come in one after the other, are joined to some INDEX_ENTRIES entries, looked up in the
   existing levels by binary search, and equal-sized levels merge geometrically. A run whose content an earlier document has is removed whole.
3. Where runs of different content share an anchor word, as at the ends of a copied passage, their documents
   send the hashes of the single strings of these runs through the same kind of index.
4. Both answers go to the documents by doc_id, which remove what they cover.

Arrays hold a content once for each batch, not for each document; what a batch decides by itself, its repeats and its
crowded anchor words, is dealt to the key ranges in turn. An anchor word with more than CROWD contents in a batch is known
to be shared: its entries go straight to step 3, and two of them, of the smallest and the largest document, stand
for it in its key range. So a passage in a third of all documents, whose ends have a content for each of them, adds
no more than CROWD entries of a batch to one group. Texts are shuffled once, by doc_id, and used in 3 and 4.

An array has a part for each key range, so parts are batches times key ranges. Beyond FINE_BUCKETS key ranges, batches and
key ranges both grow with the root of the input, and a part keeps its size, up to COARSEST times either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import shuffles_dropped, stored

LENGTH = 50
K = 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
FINE_BUCKETS = 1024
COARSEST = 4
BATCH_ENTRIES = 1 << 19
INDEX_ENTRIES = 1 << 16
PART_ENTRIES = 1 << 12
CROWD = 16
CHUNK_BYTES = 1 << 16  # arrays of 8 bytes for each byte then stay in the heap, where larger ones are new pages each time
SLICE_BYTES = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_pressing, _opening = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # one of each for all of a worker's small parts


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA24BAED4963EE407)
    x ^= x >> _U(32)
    return x


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < size:
        made = []
        for value in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers[base] = tuple(made)
    return _powers[base]


class Chunk:
    """Concatenated documents, or segments of long ones that overlap so that each string starts in one of them."""

    def __init__(self, segments: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(s for _, _, s in segments), np.uint8)
        self.docs, self.offsets, self.sizes = (np.array(c, np.int64) for c in zip(*((d, o, len(s)) for d, o, s in segments)))
        self.size, self.sums = len(data), []
        for base in _BASES:
            total = np.zeros(self.size + 1, np.uint64)
            np.cumsum(data * _power_tables(base, CHUNK_BYTES)[0][: self.size] if self.size <= CHUNK_BYTES else
                      data * _power_tables(base, self.size)[0][: self.size], out=total[1:])
            self.sums.append(total)
        starts = max(0, self.size - LENGTH + 1)
        borders, crossing = np.cumsum(self.sizes)[:-1], np.zeros(starts + 1, np.int32)
        np.add.at(crossing, np.clip(borders - LENGTH + 1, 0, starts), 1)
        np.add.at(crossing, np.minimum(borders, starts), -1)
        self.whole = np.cumsum(crossing[:-1]) == 0

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each byte."""
        return np.repeat(self.docs, self.sizes)

    @cached_property
    def place(self) -> np.ndarray:
        """The place in its document of each byte."""
        return np.arange(self.size) - np.repeat(np.cumsum(self.sizes) - self.sizes - self.offsets, self.sizes)

    def hashes(self, which: int, start, stop) -> np.ndarray:
        inverse = _power_tables(_BASES[which], self.size + 1)[1]
        sums = self.sums[which]
        return (sums[stop] - sums[start]) * inverse[start]

    def windows(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, a, b) of every string of LENGTH bytes, or of those with the given starts: a and b are 64 and 16 bits of its hashes."""
        at = np.flatnonzero(self.whole) if at is None else at
        if 4 * len(at) > len(self.whole):  # hashes of all starts cost less than picking the summands of many
            raw = [self.hashes(which, slice(0, len(self.whole)), slice(LENGTH, self.size + 1))[at] for which in (0, 1)]
        else:
            raw = [self.hashes(which, at, at + LENGTH) for which in (0, 1)]
        return at, _mix(raw[0]), _mix(raw[1]) >> _U(48)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, a, b) of the runs: a has 48 bits of the anchor word and 16 of the content, b its other 48."""
        if not self.whole.any():
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        every = np.arange(self.size - K + 1)
        words = self.hashes(0, slice(0, self.size - K + 1), slice(K, self.size + 1))
        least = (_mix(words) & _U(0xFFFFFFFF00000000)) | every.astype(np.uint64)
        width, wanted = 1, LENGTH - K + 1
        while width * 2 <= wanted:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < wanted:
            least = np.minimum(least[: width - wanted], least[wanted - width :])
        anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
        moved = np.ones(len(anchor) + 1, bool)
        moved[1:-1] = anchor[1:] != anchor[:-1]
        moved[1:-1] |= ~(self.whole[1:] & self.whole[:-1])
        first, last = np.flatnonzero(moved[:-1] & self.whole), np.flatnonzero(moved[1:] & self.whole)
        content = _mix(self.hashes(1, first, last + LENGTH) + (last - first).astype(np.uint64) * _U(_BASES[0]))
        key = _mix(words[anchor[first]] * _U(0x9FB21C651E98DF25) + _U(1)) >> _U(16)
        return first, last, (key << _U(16)) | (content >> _U(48)), content & _U(0xFFFFFFFFFFFF)


def chunks(texts: Iterable[bytes]) -> Iterator[Chunk]:
    """Chunks of the texts, numbered in their order."""
    held, size = [], 0
    for number, text in enumerate(texts):
        step = CHUNK_BYTES - LENGTH + 1
        for start in range(0, max(1, len(text) - LENGTH + 1), step):
            part = text[start : start + CHUNK_BYTES]
            if size + len(part) > CHUNK_BYTES and held:
                yield Chunk(held)
                held, size = [], 0
            held.append((number, start, part))
            size += len(part)
    if held:
        yield Chunk(held)


def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for an entry, by which its documents find it again."""
    return _mix(a ^ (b.astype(np.uint64) * _U(_BASES[1]))).view(np.int64)


# ---------------------------------------------------------------- sorted hashes and their levels


def _pack(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> bytes:
    base = int(doc.min(initial=1 << 62)) if len(doc) else 0
    columns = [np.diff(a, prepend=_U(0)), b.astype(np.uint64), (doc - base).astype(np.uint64)]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return np.array([len(a), base], "<i8").tobytes() + _pressing.compress(b"".join(planes))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base = (int(v) for v in np.frombuffer(data[:16], "<i8"))
    planes = np.frombuffer(_opening.decompress(data[16:]), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for _ in range(3):
        out.append(np.ascontiguousarray(planes[at : at + 8 * n].reshape(8, n).T).reshape(-1).view(np.uint64))
        at += 8 * n
    return np.cumsum(out[0], dtype=np.uint64), out[1], out[2].astype(np.int64) + base


def sorted_entries(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[tuple, tuple]:
    """Entries in order of their hashes (not of the bytes), each once with its smallest document; and those of its other documents."""
    order = np.argsort(a)
    same = np.diff(a[order]) == 0
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(a) else order
    among = order[tied]
    order[tied] = among[np.lexsort((doc[among], b[among], a[among]))]
    a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else doc
    other = doc > smallest
    other[1:] &= new[1:] | (doc[1:] != doc[:-1])
    return (a[new], b[new], doc[new]), (a[other], b[other], doc[other])


def _anchors(a: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the sorted entries: its anchor word's number, entries, smallest and largest document."""
    key = a >> _U(16)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(starts, append=len(key))
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    return tuple(np.repeat(column, sizes) for column in (np.arange(len(starts)), sizes, low, high))


def crowded(a: np.ndarray, b: np.ndarray, doc: np.ndarray, crowd: int) -> tuple[tuple, tuple]:
    """The entries that go to the key ranges; and those of anchor words with more than `crowd` entries of several documents,
    which are known to be shared. Of these only one of the smallest and one of the largest document are among the former."""
    if not len(a):
        return (a, b, doc), (a, b, doc)
    number, size, low, high = _anchors(a, doc)
    known = (size > crowd) & (low < high)
    keep = ~known
    for end in (low, high):
        at = np.flatnonzero(known & (doc == end))
        keep[at[np.unique(number[at], return_index=True)[1]]] = True
    return (a[keep], b[keep], doc[keep]), (a[known], b[known], doc[known])


class LogIndex:
    """Sorted levels of geometrically falling size; an entry is in one level, with the smallest document so far."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes in sorted entries; gives the entries (of either side) that a smaller document turns out to have."""
        removed = []
        for level in self.levels:
            la, lb, ld = level
            at, step = np.searchsorted(la, a), 0
            open_ = np.flatnonzero(la[np.minimum(at, len(la) - 1)] == a)
            found = np.full(len(a), -1)
            while len(open_):  # over entries that share `a`, which are few
                place = at[open_] + step
                inside = place < len(la)
                open_, place = open_[inside], place[inside]
                same = la[place] == a[open_]
                open_, place = open_[same], place[same]
                hit = lb[place] == b[open_]
                found[open_[hit]] = place[hit]
                open_, step = open_[~hit], step + 1
            hit = np.flatnonzero(found >= 0)
            place = found[hit]
            later, earlier = doc[hit] > ld[place], doc[hit] < ld[place]
            removed.append((a[hit][later], b[hit][later], doc[hit][later]))
            removed.append((a[hit][earlier], b[hit][earlier], ld[place[earlier]].copy()))
            ld[place[earlier]] = doc[hit][earlier]
            rest = found < 0
            a, b, doc = a[rest], b[rest], doc[rest]
        if len(a):
            self.levels.append([a, b, doc.copy()])
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()
        return tuple(np.concatenate(c) for c in zip(*removed)) if removed else (a[:0], b[:0], doc[:0])

    def _merge(self) -> None:
        one, two = self.levels.pop(), self.levels.pop()
        joined = [np.concatenate(c) for c in zip(two, one)]
        order = np.argsort(joined[0], kind="stable")  # two sorted parts are merged
        self.levels.append([c[order] for c in joined])

    def shared_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries whose anchor word other entries of other documents have too."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        a, b, doc = self.levels[0]
        _, _, low, high = _anchors(a, doc)
        keep = low < high
        return a[keep], b[keep], doc[keep]


# ---------------------------------------------------------------- the stages

_REMOVED, _SHARED = 0, 1
_BLOBS = "bucket int, batch long, data binary, repeats binary, asked binary"
_ANSWERS = "doc_id long, code long, kind int"


def _blobs(entries: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, crowd: int | None = None) -> Iterator[pd.DataFrame]:
    """Sorted arrays of a task's entries (a, b, doc_id), one for each of its batches, cut in key ranges.

    What the batch has decided by itself needs no certain range: it is cut in parts of PART_ENTRIES, dealt to the ranges in turn.
    """
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    for number, (a, b, doc) in enumerate(entries):
        main, others = sorted_entries(a, b, doc)
        main, known = (main, tuple(c[:0] for c in main)) if crowd is None else crowded(*main, crowd)
        turn = int(_mix(np.array([first + number], np.uint64))[0] % _U(buckets))
        rows = []
        for place, columns in enumerate((main, others, known)):
            if place:
                at = np.append(np.arange(0, len(columns[0]), PART_ENTRIES), len(columns[0]))
            else:
                of = ((columns[0] >> _U(32)) * _U(buckets)) >> _U(32)
                at = np.searchsorted(of, np.arange(buckets + 1))
            for part in np.flatnonzero(np.diff(at)).tolist():
                packed = [None, None, None]
                packed[place] = _pack(*(c[at[part] : at[part + 1]] for c in columns))
                rows.append(((part + turn * (place > 0)) % buckets, first + number, *packed))
        yield pd.DataFrame(rows, columns=["bucket", "batch", "data", "repeats", "asked"])


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """The parts as one; the list is emptied, so that they are not held beside it."""
    columns = tuple(np.concatenate(c) for c in zip(*parts))
    parts.clear()
    return columns


def _batched(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple]:
    """Neighbours with `rows` entries or more; what is left of them in the end goes with the last, if it is less than half of that."""
    ready, held, size = [], [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            if ready:
                yield _joined(ready)
            ready, held, size = held, [], 0
    if ready and 2 * size < rows:
        ready, held = ready + held, []
    for last in (ready, held):
        if last:
            yield _joined(last)


def _answers(rows: list[tuple[tuple, int]]) -> pd.DataFrame:
    if not rows:
        return pd.DataFrame({"doc_id": [], "code": [], "kind": []}).astype("int64")
    a, b, doc = (np.concatenate(c) for c in zip(*(entries for entries, _ in rows)))
    kind = np.repeat(np.array([kind for _, kind in rows], np.int32), [len(entries[0]) for entries, _ in rows])
    return pd.DataFrame({"doc_id": doc, "code": code(a, b), "kind": kind})


def _looked_up(group: pd.DataFrame, shared: bool) -> pd.DataFrame:
    """The answers of a key range. Its arrays are joined before they are looked up, so the steps follow their entries, not their number."""
    index, rows = LogIndex(), []
    group = group.sort_values("batch")
    for entries in _batched(map(_unpack, group["data"].dropna()), INDEX_ENTRIES):
        main, others = sorted_entries(*entries)
        rows += [(others, _REMOVED), (index.add(*main), _REMOVED)]
    for name, kind in (("repeats", _REMOVED), ("asked", _SHARED)):
        rows += [(_unpack(part), kind) for part in group[name].dropna()]
    if shared:
        rows.append((index.shared_anchors(), _SHARED))
    return _answers(rows)


def _indexed(blobs: DataFrame, shared: bool) -> DataFrame:
    """Runs each key range's batches through its levels; gives answers (doc_id, code, kind)."""

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        return _looked_up(group, shared)

    return blobs.groupBy("bucket").applyInPandas(scan, _ANSWERS)


def _marks(doc: np.ndarray, codes: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Which entries (document number, code) are in their document's list. The entries come in order of their documents.

    Only the lists of these documents are looked at, and only entries whose first bits some list has are compared.
    """
    if not len(doc):
        return np.zeros(0, bool)
    wanted = wanted[doc[0] : doc[-1] + 1]
    numbers = np.repeat(np.arange(doc[0], doc[-1] + 1), [len(w) for w in wanted]).astype(np.uint64)
    asked = np.concatenate([*wanted, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    codes, salt = codes.view(np.uint64), _U(0x9FB21C651E98DF25)
    unused = _U(64 - max(10, len(asked).bit_length() + 4))
    bits = np.zeros(1 << (64 - int(unused)), bool)
    bits[asked >> unused] = True
    hit = bits[codes >> unused]
    near = np.flatnonzero(hit)
    hit[near] = np.isin(_mix(codes[near] + doc[near].astype(np.uint64) * salt), _mix(asked + numbers * salt))
    return hit


def covered(texts: list[bytes], runs: list[np.ndarray], windows: list[np.ndarray]) -> list[np.ndarray]:
    """For each text a flag for each byte: whether it is in one of the document's listed runs or strings."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins, edges = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int32)  # a text's edges sum to 0
    single = np.array([len(w) > 0 for w in windows], bool)
    for chunk in chunks(texts):
        first, last, a, b = chunk.runs()
        at, wa, wb = chunk.windows(np.flatnonzero(chunk.whole & single[chunk.doc[: len(chunk.whole)]]))
        for start, stop, codes, wanted in ((first, last, code(a, b), runs), (at, at, code(wa, wb), windows)):
            hit = np.flatnonzero(_marks(chunk.doc[start], codes, wanted))
            begin = begins[chunk.doc[start[hit]]]
            np.add.at(edges, begin + chunk.place[start[hit]], 1)
            np.add.at(edges, begin + chunk.place[stop[hit]] + LENGTH, -1)
    inside = np.cumsum(edges, dtype=np.int32) > 0
    return [inside[begin : begin + len(t)] for begin, t in zip(begins, texts)]


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Neighbours of about SLICE_BYTES in all."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _extent(total: int, batch: int) -> tuple[int, int]:
    """How many key ranges `total` bytes of text get, and the entries of a batch."""
    coarse = min(COARSEST, max(1, math.sqrt(total / BUCKET_BYTES / FINE_BUCKETS)))
    return max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES / coarse)), int(batch * coarse)


def remove_repeated(docs: DataFrame, with_kept: bool = False, batch: int = BATCH_ENTRIES, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`, and on demand kept, the bytes left.

    `docs` has doc_id and text; more columns are ignored. A byte is removed if a string of LENGTH bytes that covers
    it also starts in a document with a smaller doc_id, in the input. A null text is empty. Rows that share a
    doc_id are not earlier than each other; rows with a null doc_id are neither earlier nor later than any.
    An empty table gives no rows. Results do not depend on `batch`, the entries of a sorted array, or `crowd`.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, batch = _extent(total, batch)

    def run_arrays(frames):
        def parts():
            for frame in frames:
                ids = frame["doc_id"].to_numpy()
                for chunk in chunks(t.encode() for t in frame["text"]):
                    first, _, a, b = chunk.runs()
                    yield a, b, ids[chunk.doc[first]]

        yield from _blobs(_batched(parts(), batch), buckets, crowd)

    arrays = keyed.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(run_arrays, _BLOBS)
    with shuffles_dropped(docs.sparkSession):  # the arrays are read once
        answers = stored(_indexed(arrays, shared=True))

    def window_arrays(frames):
        def parts():
            for frame in frames:
                frame = frame[frame["codes"].notna() & frame["text"].notna()]
                ids, wanted = frame["key"].to_numpy(), list(frame["codes"])
                for chunk in chunks(t.encode() for t in frame["text"]):
                    first, last, a, b = chunk.runs()
                    hit = _marks(chunk.doc[first], code(a, b), wanted)
                    inside = np.zeros(chunk.size + 1, np.int64)
                    inside[first[hit]] += 1
                    inside[last[hit] + 1] -= 1
                    at, wa, wb = chunk.windows(np.flatnonzero(np.cumsum(inside) > 0))
                    yield wa, wb, ids[chunk.doc[at]]

        yield from _blobs(_batched(parts(), batch), buckets)

    def by_document(frame: DataFrame, *kinds: tuple[str, str]) -> DataFrame:
        lists = [F.collect_list(F.when(F.expr(kind), F.col("code"))).alias(name) for name, kind in kinds]  # a document's own
        return frame.groupBy(F.col("doc_id").alias("key")).agg(*lists)

    asked = by_document(answers.where(F.col("kind") == _SHARED), ("codes", "true"))
    asking = keyed.join(asked, "key", "left").select("key", "text", F.expr("CASE WHEN doc_id IS NOT NULL THEN codes END").alias("codes"))
    strings = _indexed(asking.mapInPandas(window_arrays, _BLOBS), shared=False)
    every = answers.where(F.col("kind") == _REMOVED).union(strings.withColumn("kind", F.lit(2)))
    lists = by_document(every, ("runs", f"kind = {_REMOVED}"), ("windows", "kind = 2"))

    def cut(texts: pd.Series, runs: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for part in _slices(texts):
            values = [(t or "").encode() for t in texts.iloc[part]]
            lists = [[np.zeros(0, np.int64) if c is None else np.asarray(c, np.int64) for c in column.iloc[part]] for column in (runs, windows)]
            able = [i for i in range(len(values)) if len(lists[0][i]) + len(lists[1][i])]
            flags = dict(zip(able, covered([values[i] for i in able], *([column[i] for i in able] for column in lists))))
            for i, value in enumerate(values):
                gone = flags.pop(i, None)
                kept = value if gone is None else np.frombuffer(value, np.uint8)[~gone].tobytes()
                spans = 0 if gone is None else int((gone[1:] > gone[:-1]).sum()) + bool(gone[:1].any())
                rows.append((len(value), len(value) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])])

    cut_udf = F.pandas_udf(cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    own = [F.expr(f"CASE WHEN doc_id IS NOT NULL THEN {name} END") for name in ("runs", "windows")]
    return keyed.join(lists, "key", "left").select("doc_id", cut_udf("text", *own).alias("cut")).select("doc_id", "cut.*")
