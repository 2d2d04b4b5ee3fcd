"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries are fixed-point integers, so sums and the centred scatter are exact
whatever the order of rows and tasks: one pass gives the sums, a second the
products of rows centred at the rounded-down means, and the rest of the mean is
taken off exactly.  The matrix of the dimensions' covariances (never the rows)
reaches the driver.  Rotations make the columns of its factor orthogonal: their
squared norms are the eigenvalues, their directions the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import slices, written

# Fixed values of the contract.
STEP = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries from here on do not fit a long after scaling; their vectors count as not finite.
LIMIT = 2.0**40
#: Sums below this stay in 64-bit integers; beyond it Python's integers take over.
_SAFE = 1 << 62
_EXACT = 1 << 53


@dataclass
class Fit:
    """Mean parts (exact), components and eigenvalues of the covariance."""

    n: int
    centre: list[int]  # rounded-down mean of each dimension
    rest: list[int]  # sum of the entries less n times the centre
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has no null, non-finite or oversized entry."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    return vectors.where(F.col(column).isNotNull() & ~bad)


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * STEP).astype(np.int64) + SHIFT).reshape(-1, dim)


def _span(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less the centre, in Python's integers where 64 bits could overflow."""
    if max(_span(x), max((abs(c) for c in centre), default=0)) < _SAFE:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of the rows of y."""
    span = _span(y)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    if span == 0:
        return out
    if span * span >= _EXACT:
        wide = y.astype(object)
        return wide.T.dot(wide)
    # sums of a block stay below 2**53, so floating point is exact
    step = _EXACT // (span * span)
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums(vectors: DataFrame, dim: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for b in slices(batches, "embedding"):
            x = _entries(b.column("embedding"), dim)
            total += x.sum(axis=0).astype(object) if _span(x) * len(x) < _SAFE else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([str(v) for v in total])], ["i", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * dim
    for r in rows:
        out[r["i"]] = int(r["s"])
    return out


def _scatter(vectors: DataFrame, dim: int, centre: list[int]) -> list[list[int]]:
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for b in slices(batches, "embedding"):
            total += _products(_centred(_entries(b.column("embedding"), dim), centre))
        cells = [pa.array(x.astype(np.int32)) for x in upper]
        yield pa.RecordBatch.from_arrays([*cells, pa.array([str(v) for v in total[upper]])], ["i", "j", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [[0] * dim for _ in range(dim)]
    for r in rows:
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["s"])
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with v[order][:, order] = factor @ factor.T; columns end where the rest is rounding error."""
    d = len(v)
    rest, order, columns = v.astype(np.float64).copy(), np.arange(d), []
    least = d * np.finfo(float).eps * max(float(np.diag(rest).max()), 0.0) if d else 0.0
    for k in range(d):
        best = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[best, best] <= least:
            break
        if best != k:
            rest[[k, best]] = rest[[best, k]]
            rest[:, [k, best]] = rest[:, [best, k]]
            order[[k, best]] = order[[best, k]]
            for c in columns:
                c[[k, best]] = c[[best, k]]
        column = np.zeros(d)
        column[k:] = rest[k:, k] / np.sqrt(rest[k, k])
        columns.append(column)
        rest[k + 1 :, k + 1 :] -= np.outer(column[k + 1 :], column[k + 1 :])
    return np.array(columns).T.reshape(d, len(columns)), order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns of a factor until they are orthogonal; each round rotates disjoint pairs at once."""
    a = factor.copy()
    r = a.shape[1]
    if r < 2:
        return a
    seats = list(range(r)) + ([-1] if r % 2 else [])
    half, done = len(seats) // 2, np.finfo(float).eps * max(1.0, np.sqrt(len(a)) / 4)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(x, y) for x, y in zip(seats[:half], seats[:half - 1 : -1], strict=True) if x >= 0 and y >= 0]
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            left, right = a[:, p], a[:, q]
            pp, qq, pq = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(pp * qq)
            apart = np.abs(pq) > done * size
            worst = max(worst, float((np.abs(pq) / np.where(size > 0, size, 1)).max()))
            t = np.zeros(len(p))
            zeta = (qq[apart] - pp[apart]) / (2 * pq[apart])
            t[apart] = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * (left - t * right), c * (right + t * left)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= done:
            break
    return a


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance by falling eigenvalue; the largest entry of each is positive."""
    factor, order = pivoted_cholesky(v)
    rotated = jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(rotated)
    vectors[order] = rotated / norms
    vectors = vectors[:, by]
    if vectors.size:
        vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return norms[by] ** 2, vectors


def fit(vectors: DataFrame) -> tuple[DataFrame, Fit | None]:
    """The rows of the fit list, and what is learnt of them; None where there are none.

    All vectors of the most frequent length (the greater of equals) are the
    list; those of other lengths are left out.
    """
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths or not lengths[0]["dim"]:
        return rows.limit(0), None
    dim, n = lengths[0]["dim"], lengths[0]["n"]
    rows = rows.where(F.size("embedding") == dim)
    sums = _sums(rows, dim)
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    g = _scatter(rows, dim, centre)
    # true division of Python's integers rounds once
    v = np.array([[(n * g[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    eigenvalues, found = components_of(v)
    return rows, Fit(n, centre, rest, found, eigenvalues, float(np.trace(v)))


def _projected(rows: DataFrame, f: Fit, k: int) -> DataFrame:
    """vec_id, deviation, w (array of k whitened values) of each row."""
    dim, n = len(f.centre), f.n
    basis = f.components[:, :k] / np.sqrt(f.eigenvalues[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = max(abs(x) for x in f.rest)
        for b in slices(batches, "embedding"):
            y = _centred(_entries(b.column("embedding"), dim), f.centre)
            if dim * (n * _span(y) + rest) ** 2 < _SAFE:
                moved = n * y.astype(np.int64) - np.array(f.rest, np.int64)
                deviation = (moved * moved).sum(axis=1).tolist()
            else:
                moved = n * y.astype(object) - np.array(f.rest, object)
                deviation = [int(x) if x < 1 << 63 else None for x in (moved * moved).sum(axis=1)]
            w = (moved / n).astype(np.float64) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component.

    Rows with a null vector, or one with a null, non-finite or oversized entry
    (2**40 and more), or of an unusual length are left out.  There are as many
    components as the covariance has rank, at most `components`; none for an
    empty table, a single row or equal rows, which so give no rows.  Null and
    repeated ids are kept row by row; further columns are not read.  `deviation`
    is null where it passes the range of long.
    """
    rows, f = fit(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    k = 0 if f is None else min(components, len(f.eigenvalues))
    if not k:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    table = written(_projected(rows, f, k), "whitened")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    covariances = table.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in cells)).first()
    error = max(abs(covariances[f"c{i}_{j}"] - (i == j)) for i, j in cells)
    explained = F.array(*(F.lit(float(e) / f.trace) for e in f.eigenvalues[:k]))
    long = table.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(f.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
