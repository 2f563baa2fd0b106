"""Packing documents into sequences of a fixed number of tokens by linear grouping.

How to pack depends only on how many pieces there are of each length, so the plan is made from a
histogram with one row per length, at most `capacity` of them whatever the corpus:

1. lengths above `capacity / part` form GROUPS groups of equal cardinality, longest first, and are
   rounded up to the longest of their group;
2. a linear program over configurations of these few sizes (columns generated by a knapsack) says how
   often each configuration is used; fractions are rounded down;
3. actual lengths take the places of their group, which gives the real space left in each sequence;
4. what is left over and the small lengths go, longest first, to the sequence with the least space that fits.

The plan is made for each of PARTS, and the one with the fewest sequences is used.
Sequences that are filled alike are kept as one row with a count. Pieces are then numbered within their
length, over salted groups so that a common length is no hot key, and the number gives the place.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import row_salt, stored
from .tokens import RANKS, TOKENIZER, tokenizer

CAPACITY = 2048
END_ID = 0
GROUPS = 48
PARTS = (2, 3, 4)
SALTED_ROWS = 10_000
LEAST_SALTS = 64

Filling = list[tuple[int, int]]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of `docs` (doc_id, text).

    A document is the ids of its text and the end id. Longer ones are cut into pieces of `capacity`; the
    first piece takes what does not fill one. A null text is empty, so every row has a piece.
    """

    def pieces(batches):
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids, out = tokenizer(path, ranks).ids, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids(text or "") + end
                total, start = len(data) // 4, 0
                stop = (total - 1) % capacity + 1
                piece = 0
                while start < total:
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    piece, start, stop = piece + 1, stop, stop + capacity
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan, from the histogram


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, in groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    bounds = [round(total * (i + 1) / groups) for i in range(groups)]
    out, current, seen = [], [], 0
    for length, n in lengths:
        while n:
            take = min(n, bounds[len(out)] - seen)
            if take:
                current.append((length, take))
            seen, n = seen + take, n - take
            while len(out) < groups and seen == bounds[len(out)]:
                if current:
                    out.append(current)
                    current = []
                else:
                    bounds.pop(len(out))
                    groups -= 1
                if len(out) == groups:
                    break
    return out


def _best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most."""
    worth, layers = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        grown, choice = worth.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            candidate = worth[: capacity + 1 - size] + values[i]
            better = candidate > grown[size:] + 1e-12
            grown[size:][better], choice[size:][better] = candidate[better], i
        layers.append(choice)
        worth = grown
    chosen, room = np.zeros(len(sizes)), capacity
    for choice in reversed(layers):
        if choice[room] >= 0:
            chosen[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return chosen


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of uses of configurations, from the linear program's optimum rounded down."""
    basis = np.diag((capacity // sizes).astype(float))
    uses = demand / np.diag(basis)
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_configuration(prices, sizes, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(ratios.argmin())
        uses = np.maximum(uses - ratios[leaving] * change, 0)
        uses[leaving] = ratios[leaving]
        basis[:, leaving] = column
    return [(basis[:, i].round().astype(int), int(uses[i] + 1e-6)) for i in range(len(sizes))]


def _substitute(groups: list, configurations: list[tuple[np.ndarray, int]]) -> list[tuple[int, Filling]]:
    """Sequences filled with actual lengths, as (count, filling); takes them out of `groups`."""
    queues = [list(reversed(g)) for g in groups]
    out = []
    for column, count in configurations:
        slots = [i for i, k in enumerate(column) for _ in range(int(k))]
        while count and slots:
            if any(not queues[i] for i in slots):
                break
            heads = {i: queues[i][-1] for i in slots}
            times = min([count, *(heads[i][1] // slots.count(i) for i in heads)])
            if times:
                filling = [(heads[i][0], slots.count(i)) for i in sorted(heads)]
                for i in heads:
                    _take(queues[i], slots.count(i) * times)
                count -= times
            else:  # a run ends inside this sequence
                wanted = {i: slots.count(i) for i in heads}
                if any(sum(n for _, n in queues[i]) < k for i, k in wanted.items()):
                    break
                filling = [pair for i, k in sorted(wanted.items()) for pair in _take(queues[i], k)]
                times, count = 1, count - 1
            out.append((times, filling))
    for group, queue in zip(groups, queues):
        group[:] = reversed(queue)
    return out


def _take(queue: list[tuple[int, int]], wanted: int) -> Filling:
    taken = []
    while wanted:
        length, n = queue.pop()
        k = min(n, wanted)
        taken.append((length, k))
        wanted -= k
        if n > k:
            queue.append((length, n - k))
    return taken


def _best_fit(items: list[tuple[int, int]], sequences: list[tuple[int, Filling]], capacity: int) -> list[tuple[int, Filling]]:
    """Places (length, count), longest first, each where the least space is left that fits it."""
    spaces: dict[int, list[tuple[int, Filling]]] = {}
    order: list[int] = []

    def put(count: int, filling: Filling) -> None:
        space = capacity - sum(length * k for length, k in filling)
        if space not in spaces:
            spaces[space] = []
            insort(order, space)
        spaces[space].append((count, filling))

    for sequence in sequences:
        put(*sequence)
    for length, n in items:
        while n:
            space = next((s for s in order[np.searchsorted(order, length) :] if spaces[s]), None)
            if space is None:
                per = capacity // length
                count, filling = max(1, n // per), []
            else:
                per = space // length
                count, filling = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space]
                    order.remove(space)
            full = min(count, n // per)
            if full:
                put(full, [*filling, (length, per)])
                n, count = n - full * per, count - full
            if count and n and n < per:
                put(1, [*filling, (length, n)])
                n, count = 0, count - 1
            if count and filling:
                put(count, filling)
    return [pair for s in order for pair in spaces[s]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, Filling]]:
    """(number of sequences, [(length, times)]) for so many pieces of each length."""
    plans = (_plan(histogram, capacity, groups, part) for part in PARTS)
    return min(plans, key=lambda sequences: sum(count for count, _ in sequences))


def _plan(histogram: dict[int, int], capacity: int, groups: int, part: int) -> list[tuple[int, Filling]]:
    ordered = sorted(histogram.items(), reverse=True)
    full = [(n, [(length, 1)]) for length, n in ordered if length == capacity]
    large = [(length, n) for length, n in ordered if capacity // part < length < capacity]
    small = [(length, n) for length, n in ordered if length <= capacity // part]
    filled: list[tuple[int, Filling]] = []
    if large:
        grouped = _groups(large, min(groups, sum(n for _, n in large)))
        sizes = np.array([g[0][0] for g in grouped])
        demand = np.array([sum(n for _, n in g) for g in grouped], dtype=float)
        filled = _substitute(grouped, _configurations(sizes, demand, capacity))
        large = [pair for g in grouped for pair in g]
    return full + _best_fit(large + small, filled, capacity)


def _places(sequences: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """By (length, first number): what turns a piece's number within its length into its place."""
    rows, numbered, first = [], {}, 0
    for count, filling in sequences:
        offset = 0
        for length, times in filling:
            low = numbered.get(length, 0)
            rows.append((length, low, times, first, offset))
            numbered[length] = low + count * times
            offset += length * times
        first += count
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "low", "times", "first", "offset"), columns))


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """One row per piece of `docs` (doc_id, text; more columns are ignored): doc_id, piece, start, length,
    ids_crc32, and its place: sequence_id and the offset there.

    A null text is empty and packs as its end id. Repeated rows are packed as often as they occur. An
    empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, capacity, path, ranks))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    salts = max(LEAST_SALTS, sum(histogram.values()) // SALTED_ROWS)
    salted = pieces.withColumn("salt", row_salt(salts, "doc_id", "piece"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("number", number).join(
        sizes.select("length", "salt", before.alias("before")), ["length", "salt"]
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, numbers = length.to_numpy(), number.to_numpy()
        out = np.zeros((2, len(lengths)), dtype=np.int64)
        for value in np.unique(lengths):
            own = lengths == value
            lo, hi = np.searchsorted(places["length"], [value, value + 1])
            row = lo + np.searchsorted(places["low"][lo:hi], numbers[own], side="right") - 1
            beyond, times = numbers[own] - places["low"][row], places["times"][row]
            out[0, own] = places["first"][row] + beyond // times
            out[1, own] = places["offset"][row] + beyond % times * value
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = numbered.withColumn("place", place("length", F.col("number") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
