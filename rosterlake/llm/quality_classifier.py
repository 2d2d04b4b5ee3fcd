"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs are the distinct words of the whole text (hashed), bins of structure
statistics, and metadata (the stored length against the measured one); never
lang, source, doc_id or labels.  All pairs of features interact through rank-R
vectors, and a row is scored in linear time:
sum over pairs of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import FEATURES, document_stats, labelled
from .storage import drop, slices, written
from .textscan import scan, sorted_unique_by_doc, word_hash

BUCKETS = 1 << 15
BINS = 12
RANK = 8
#: Labelled documents that the machine is fitted on, at most.
MAX_TRAIN_ROWS = 8_000
#: Fixed value of the contract.
THRESHOLD = 0.3
EPOCHS = 6
#: One in so many training rows is left out of the fit and calibrates the scores.
CALIBRATE = 5
BATCH = 256
N_FEATURES = BUCKETS + (len(FEATURES) + 1) * BINS
WORD_WEIGHT = 1.0


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # N_FEATURES x RANK
    edges: np.ndarray  # bin edges of each statistic
    slope: float = 1.0  # calibration of the margin
    shift: float = 0.0

    def margin(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Every row holds a feature at least (its bins), so no segment is empty."""
        at = first[:-1]
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, at)
        squares = np.add.reduceat((vx * vx).sum(1), at)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + 0.5 * ((total * total).sum(1) - squares)


    def probability(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(index, value, first) + self.shift, -500, 500)))


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins (Newton steps, smoothed labels); none for one class."""
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return 1.0, 0.0
    want = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.stack((margin, np.ones(len(y))), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - want))
        w = w - np.clip(step, -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def features(column: pa.Array, n_chars: pa.Array | None, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (index, value, n + 1 borders): distinct word buckets of equal weight, and a bin of each statistic."""
    s = scan(column)
    n = len(s.first) - 1
    words, first = sorted_unique_by_doc(word_hash(s) % np.uint64(BUCKETS), s.doc_of_word(), n)
    _, x = document_stats(column)
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    lead = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))[s.doc_start]
    stored = np.array([-1 if c is None else c for c in n_chars.to_pylist()]) if n_chars is not None else np.full(n, -1)
    agree = np.where(stored < 0, 0, np.where(stored == np.diff(lead), 1, 2))
    fixed = np.concatenate((bins, agree[:, None]), 1) + BUCKETS + np.arange(len(FEATURES) + 1) * BINS
    width = fixed.shape[1]
    counts = np.diff(first)
    borders = np.concatenate(([0], np.cumsum(counts + width)))
    index, value = np.empty(borders[-1], np.int64), np.empty(borders[-1])
    place = np.arange(len(words)) + np.repeat(width * np.arange(1, n + 1), counts)
    index[place], value[place] = words.astype(np.int64), np.repeat(WORD_WEIGHT / np.sqrt(np.maximum(counts, 1)), counts)
    head = (borders[:-1, None] + np.arange(width)).ravel()
    index[head], value[head] = fixed.ravel(), 1 / np.sqrt(width)
    return index, value, borders


def fit(index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, edges: np.ndarray, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss; one class or no rows give that class's smoothed frequency."""
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(rate_1 / (1 - rate_1))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)), edges)
    if not len(y) or y.min() == y.max():
        return m
    m.factors = rng.normal(0, 0.05, (N_FEATURES, RANK))
    g_lin, g_fac, rate, l2 = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 0.1, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            lengths = first[rows + 1] - first[rows]
            borders = np.concatenate(([0], np.cumsum(lengths)))
            place = np.arange(borders[-1]) + np.repeat(first[rows] - borders[:-1], lengths)
            i, x = index[place], value[place]
            vx = m.factors[i] * x[:, None]
            total = np.add.reduceat(vx, borders[:-1])
            margin = m.bias + np.add.reduceat(m.linear[i] * x, borders[:-1]) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), borders[:-1]))
            d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            m.bias -= 2.0 * d.sum()
            per = np.repeat(d, lengths) * x
            used, back = np.unique(i, return_inverse=True)
            lin = np.bincount(back, per, len(used)) + l2 * m.linear[used]
            grad = per[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            fac = np.stack([np.bincount(back, grad[:, r], len(used)) for r in range(RANK)], 1) + l2 * m.factors[used]
            g_lin[used] += lin * lin
            g_fac[used] += fac * fac
            m.linear[used] -= rate * lin / np.sqrt(g_lin[used])
            m.factors[used] -= rate * fac / np.sqrt(g_fac[used])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fit on `max_rows` labelled documents at most, none of them held out (crc32 of the id mod 5 = 0)."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            _, x = document_stats(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ["x"])

    n_chars = "n_chars" if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars")
    sample = written(labelled(docs, labels, label, max_rows, n_chars), "labelled")
    seen = sample.select("text").mapInArrow(stats, "x array<double>").toPandas()
    if not len(seen):
        return fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0), np.zeros((len(FEATURES), BINS - 1)))
    edges = np.quantile(np.stack(seen["x"].to_list()), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            index, value, first = features(b.column("text"), b.column("n_chars"), edges)
            borders = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.ListArray.from_arrays(borders, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(borders, pa.array(value.astype(np.float32)))], ["doc_id", "label", "index", "value"])

    got = sample.select("doc_id", "label", "text", "n_chars").mapInArrow(rows, "doc_id long, label int, index array<int>, value array<float>").toPandas()
    drop(sample)
    got = got.sort_values("doc_id")
    aside = got["doc_id"].map(lambda i: zlib.crc32(f"calibrate {i}".encode()) % CALIBRATE == 0).to_numpy(bool)

    def sparse(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.concatenate(([0], np.cumsum(part["index"].map(len).to_numpy(np.int64)))).astype(np.int64)
        joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind) for x in part[c])])
        return joined("index", np.int64), joined("value", float), first

    machine = fit(*sparse(got[~aside]), got["label"].to_numpy(float)[~aside], edges)
    if aside.any():
        machine.slope, machine.shift = calibrated(machine.margin(*sparse(got[aside])), got["label"].to_numpy(float)[aside])
    return machine


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, n_chars, ...) -> doc_id, held_out, score, predicted; one row per row.

    Null and empty texts are scored by their statistics; a null id is not held
    out; without n_chars, or with nulls in it, that feature says so.  Extra
    columns are ignored; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = machine.probability(*features(b.column("text"), b.column("n_chars"), machine.edges))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars")
    return docs.select("doc_id", held_out, "text", n_chars).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
