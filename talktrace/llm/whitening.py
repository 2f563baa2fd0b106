"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Exact integer sums give the mean S / n; exact integer sums of products of the components less the
   whole part of the mean, and one exact correction for what is left of it, give the centred scatter. No
   large numbers cancel, and the result does not depend on the order of the rows.
2. Pivoted Cholesky factors the scatter: of P^T V P = L L^T the factor has a column for each rank.
3. One-sided Jacobi rotates the columns of L itself until they are orthogonal. Their squared norms are
   the eigenvalues, the normalised columns the components; V is never multiplied out of its factor again.
4. Rows are projected where they lie.

Tasks send sums only, a row for each dimension, folded in two levels; the driver gets one matrix of the
vectors' width, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_salt

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
SALTS = 64
_LIMB = 32
_EXACT = 1 << 53
_SWEEPS = 60
LEAST_PIVOT = 1e-10


def _clean(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows whose vector is not null and has finite components only."""
    broken = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('Infinity'))"
    whole = embeddings.where(f"embedding IS NOT NULL AND NOT {broken}")
    return whole.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def _whole(lists: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * component), rows by dimensions; shorter vectors are filled up with zeros."""
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    values = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _summed(parts: DataFrame) -> dict[int, list[int]]:
    """part -> the sums of its arrays, exact; `parts` has part, high, low (arrays of long, limbs of the summands)."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = (np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("high", "low"))
        carried = low >> _LIMB
        return pd.DataFrame({"part": rows["part"].iloc[:1], "high": [high + carried], "low": [low - (carried << _LIMB)]})

    kind = "part int, high array<long>, low array<long>"
    salted = parts.withColumn("salt", row_salt(SALTS, "part", "high", "low"))
    once = salted.groupBy("part", "salt").applyInPandas(fold, kind)
    rows = once.groupBy("part").applyInPandas(fold, kind).collect()  # one row for each dimension
    return {r["part"]: [(h << _LIMB) + v for h, v in zip(r["high"], r["low"])] for r in rows}


def _limbs(rows: dict[int, list[int]]) -> pa.RecordBatch:
    mask = (1 << _LIMB) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int32()), pa.array([[v >> _LIMB for v in r] for r in rows.values()], pa.list_(pa.int64())),
         pa.array([[v & mask for v in r] for r in rows.values()], pa.list_(pa.int64()))],
        ["part", "high", "low"],
    )


_LIMBED = "part int, high array<long>, low array<long>"


def _products(x: np.ndarray) -> np.ndarray:
    """x^T x, exact; floats serve in blocks whose sums they hold."""
    most = int(np.abs(x).max(initial=0))
    block = (_EXACT - 1) // max(1, most * most)
    if not block:
        return x.astype(object).T @ x.astype(object)
    total = np.zeros((x.shape[1],) * 2, dtype=object)
    for start in range(0, len(x), block):
        part = x[start : start + block].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def mean_of(rows: DataFrame, width: int, scale: int = SCALE) -> tuple[int, list[int]]:
    """n and the sums of floor(scale * component) + SHIFT."""

    def sums(batches):
        total, number = np.zeros(width, dtype=object), 0
        for batch in batches:
            x = _whole(batch.column(0), width, scale)
            total = total + x.astype(object).sum(axis=0) if len(x) and np.abs(x).max(initial=0) > 1 << 40 else total + x.sum(axis=0).astype(object)
            number += len(x)
        yield _limbs({0: [number, *map(int, total)]})

    n, *totals = _summed(rows.select("embedding").mapInArrow(sums, _LIMBED)).get(0, [0] * (width + 1))
    return n, [t + SHIFT * n for t in totals]


def centred_scatter(rows: DataFrame, n: int, totals: list[int], scale: int = SCALE) -> np.ndarray:
    """The covariance (divisor n) of the fit list, each entry rounded once."""
    width = len(totals)
    whole = [t // n for t in totals]
    base = np.array([w - SHIFT for w in whole], dtype=np.int64)

    def scatter(batches):
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            total = total + _products(_whole(batch.column(0), width, scale) - base)
        yield _limbs({i: list(map(int, total[i])) for i in range(width)})

    products = _summed(rows.select("embedding").mapInArrow(scatter, _LIMBED))
    left = [t - n * w for t, w in zip(totals, whole)]  # sums of what is centred, 0 to n - 1
    square = n * n
    return np.array([[(n * products[i][j] - left[i] * left[j]) / square for j in range(width)] for i in range(width)]).reshape(width, width)


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (width x rank, lower-triangular) and the order p of rows with v[p][:, p] = L L^T, greatest pivot first.

    Pivots below LEAST_PIVOT of the largest are what rounding of v leaves of zeros, and end the factor.
    """
    width = len(v)
    rest, order, factor = v.astype(float).copy(), np.arange(width), np.zeros((width, width))
    least = LEAST_PIVOT * max(0.0, float(np.diag(v).max(initial=0.0)))
    for k in range(width):
        p = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[p, p] <= least:
            return factor[:, :k], order
        for a in (rest, factor):
            a[[k, p]] = a[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(columns: np.ndarray, sweeps: int = _SWEEPS) -> np.ndarray:
    """The columns, rotated pairwise until all are orthogonal. A round rotates disjoint pairs at once."""
    a, n = columns.astype(float).copy(), columns.shape[1]
    even = n + n % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        moved = False
        for _ in range(even - 1):
            i, j = ring[: even // 2], ring[even // 2 :][::-1]
            held = (i < n) & (j < n)
            i, j = i[held], j[held]
            left, right = a[:, i], a[:, j]
            p, q, r = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            turn = np.abs(r) > np.finfo(float).eps * np.sqrt(p * q)
            if turn.any():
                moved = True
                i, j, left, right, p, q, r = i[turn], j[turn], left[:, turn], right[:, turn], p[turn], q[turn], r[turn]
                zeta = (q - p) / (2 * r)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                a[:, i], a[:, j] = c * left - c * t * right, c * t * left + c * right
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not moved:
            break
    return a


def components_of(covariance: np.ndarray, number: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: at most `number`, those of rank only.

    The entry of largest absolute value of each component is positive.
    """
    factor, order = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    values = (rotated * rotated).sum(0)
    by_value = np.argsort(-values, kind="stable")[:number]
    vectors = np.zeros((len(covariance), len(by_value)))
    vectors[order] = rotated[:, by_value] / np.sqrt(values[by_value])
    if vectors.size:
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[by_value], vectors


class Whitening:
    """Mean, eigenvalues and components of a fit list, and what they give for a batch of vectors."""

    def __init__(self, n: int, totals: list[int], covariance: np.ndarray, number: int, scale: int) -> None:
        self.n, self.totals, self.scale = n, totals, scale
        self.values, self.vectors = components_of(covariance, number)
        trace = float(np.trace(covariance))
        self.explained = [float(e) / trace for e in self.values]
        self.base = np.array([t // n - SHIFT for t in totals], dtype=np.int64)
        self.rest = np.array([t % n for t in totals], dtype=np.int64)

    def whiten(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by components, and each row's centred whole numbers n * x - S (by n) as (x - S div n, S mod n)."""
        centred = _whole(lists, len(self.totals), self.scale) - self.base
        return ((centred - self.rest / self.n) @ self.vectors) / np.sqrt(self.values), centred

    def deviations(self, centred: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exact; beyond a long it saturates."""
        reach = max((self.n * int(np.abs(centred).max(initial=0)) + self.n) ** 2 * max(1, centred.shape[1]), 1)
        if reach < 1 << 63:
            y = centred * self.n - self.rest
            return (y * y).sum(axis=1)
        y = centred.astype(object) * self.n - self.rest.astype(object)
        return np.array([min(int(v), (1 << 63) - 1) for v in (y * y).sum(axis=1)], dtype=np.int64)


def fit(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of all vectors that take part; none without a vector or where all are alike."""
    rows = _clean(embeddings)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return None
    n, totals = mean_of(rows, width, scale)
    covariance = centred_scatter(rows, n, totals, scale)
    return Whitening(n, totals, covariance, components, scale) if np.trace(covariance) > 0 else None


def identity_error(embeddings: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""
    number = len(fitted.values)
    shared = embeddings.sparkSession.sparkContext.broadcast(fitted)  # one matrix of the vectors' width

    def scatter(batches):
        total, mean = np.zeros((number, number)), np.zeros(number)
        for batch in batches:
            z, _ = shared.value.whiten(batch.column(0))
            total, mean = total + z.T @ z, mean + z.sum(axis=0)
        cells = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], ["cell", "s"])

    cells = _clean(embeddings).select("embedding").mapInArrow(scatter, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    sums = np.zeros(number * number + number)
    for r in cells.collect():  # components x components
        sums[r["cell"]] = r["s"]
    mean = sums[number * number :] / fitted.n
    covariance = sums[: number * number].reshape(number, number) / fitted.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(number)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error for every
    row of `embeddings` (vec_id, embedding) that takes part and each of at most `components` components.

    Rows whose vector is null or holds null or non-finite entries take no part; a null vec_id does. Repeated rows
    count each. Vectors shorter than the longest are filled up with zeros. Components are those of the covariance's rank, so
    an empty table, or one whose vectors are all alike, gives no rows. More columns are ignored.
    """
    spark = embeddings.sparkSession
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(embeddings, components, scale)
    if fitted is None:
        return spark.createDataFrame([], kind)
    error = identity_error(embeddings, fitted)
    shared = spark.sparkContext.broadcast(fitted)

    def project(batches):
        for batch in batches:
            z, centred = shared.value.whiten(batch.column(1))
            offsets = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.deviations(centred)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))],
                ["vec_id", "deviation", "projected"],
            )

    rows = _clean(embeddings).mapInArrow(project, "vec_id long, deviation long, projected array<double>")
    explained = F.array(*map(F.lit, fitted.explained))
    placed = rows.select("vec_id", "deviation", F.posexplode("projected").alias("place", "whitened"))
    return placed.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
