"""Quality rules: fixed limits plus gradient-boosted trees over document statistics.

Statistics are taken from every whole text; the trees are fitted on a bounded
sample of labelled rows and flattened into numpy node arrays (`gbt.Trees`).
Scores may only fall as symbols, repeated lines or repeated windows grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .storage import slices
from .textscan import SPACE, covered, per_doc, scan, segment_hash, splitmix, windows, word_hash

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Rows with labels that the trees are fitted on, at most.
MAX_TRAIN_ROWS = 20_000
#: A document stays unless the trees give it less than this chance of being good.
KEEP_FROM = 0.25

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "mark_share", "words_a_line", "distinct_share", "non_ascii_share", "caps_words_share", "symbol_words_share")
MONOTONE = np.array([-1 if f in ("symbol_share", "dup_line_share", "repeat_share") else 0 for f in FEATURES])


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _BANG, _MARK = (_class(c) for c in (SYMBOLS, bytes(range(65, 91)), bytes(range(48, 58)), b"!", b".,;:?'\"()-"))


def later_equal(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that puts equal hashes of a document side by side, and whether each equals the one before it."""
    key = splitmix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    return order, same


def repeated_in_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a hash occurs at least twice among those of its document."""
    order, same = later_equal(hashes, doc)
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(order), bool)
    out[order] = twice
    return out


def document_stats(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of STATS, and the matrix of FEATURES, for each text of the column."""
    s = scan(column)
    n = len(s.first) - 1
    words = np.diff(s.first)
    lead = (s.data & 0xC0) != 0x80
    inside = ~SPACE[s.data]
    count = lambda table: per_doc(table[s.data], s.doc_start)
    word_chars, symbols = per_doc(lead & inside, s.doc_start), count(_SYMBOL)
    hashes = word_hash(s)
    doc = s.doc_of_word()
    # lines: cut at \n and at document borders; a line counts where a word begins in it
    breaks = np.flatnonzero(s.data == 10)
    full = s.doc_start[:-1][s.doc_start[:-1] < s.doc_start[1:]]
    line_start = np.union1d(full, breaks + 1)
    line_start = line_start[line_start < len(s.data)]
    line_end = np.concatenate((line_start[1:], [len(s.data)])) if len(line_start) else line_start
    ends_in_break = s.data[line_end - 1] == 10 if len(line_start) else np.zeros(0, bool)
    line_end = line_end - ends_in_break
    has_word = np.searchsorted(s.start, line_end) > np.searchsorted(s.start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(s.doc_start, line_start, side="right") - 1
    order, same = later_equal(segment_hash(s.data, line_start, line_end), line_doc)
    lines, dup = np.bincount(line_doc, minlength=n), np.bincount(line_doc[order][same], minlength=n)
    # words that a repeated window covers
    h, ok = windows(hashes, s.first, WINDOW)
    at = np.flatnonzero(ok)
    twice = at[repeated_in_document(h[at], doc[at])]
    repeat = per_doc(covered(twice, WINDOW, len(hashes)), s.first)
    # the rest serves the trees only
    order, same = later_equal(hashes, doc)
    distinct = words - np.bincount(doc[order][same], minlength=n)
    low = per_doc((s.data >= 97) & (s.data <= 122), s.doc_start)
    upper = count(_UPPER)
    in_word = lambda table: np.logical_or.reduceat(table[s.data], s.start) if len(s.start) else np.zeros(0, bool)
    word_upper = np.add.reduceat(_UPPER[s.data].astype(np.int64), s.start) if len(s.start) else np.zeros(0)
    caps = (word_upper >= 2) & (2 * word_upper >= s.end - s.start)
    chars = np.maximum(word_chars, 1)
    share = lambda a, b: a / np.maximum(b, 1)
    x = np.stack([np.log1p(words), share(word_chars, words), symbols / chars, share(dup, lines), share(repeat, words), share(upper, upper + low), count(_DIGIT) / chars, count(_BANG) / chars, count(_MARK) / chars, share(words, lines), share(distinct, words), per_doc((s.data >= 128) & lead, s.doc_start) / chars, share(np.bincount(doc[caps], minlength=n), words), share(np.bincount(doc[in_word(_SYMBOL)], minlength=n), words)], 1)
    return dict(zip(STATS, (words, word_chars, symbols, dup, repeat), strict=True)), x


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def training_rows(labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """A bounded pseudorandom sample of labelled ids outside the held-out fifth (crc32 of the id mod 5 = 0)."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, *columns) -> DataFrame:
    """doc_id, label, text and `columns` of the training rows: one row each, the smallest by text, of ids that repeat."""
    rows = docs.select("doc_id", "text", *columns).join(F.broadcast(training_rows(labels, label, max_rows)), "doc_id")
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> gbt.Trees:
    """Fit the trees on `max_rows` labelled documents at most (that many feature rows reach the driver)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            _, x = document_stats(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = labelled(docs, labels, label, max_rows).select("doc_id", "label", "text")
    rows = sample.mapInArrow(features, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    if rows.empty:
        return gbt.train(np.zeros((0, len(FEATURES))), np.zeros(0), MONOTONE)
    return gbt.train(np.stack(rows["x"].to_list()), rows["label"].to_numpy(float), MONOTONE)


def apply_rules(docs: DataFrame, model: gbt.Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, STATS, base_failed, score, kept; one row per row.

    A null or empty text has no words and fails the base rules.  Repeated ids
    give a row each; extra columns are ignored; an empty table gives no rows.
    Without labels of both classes, the trees keep all that the base rules keep.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            stats, x = document_stats(b.column("text"))
            failed = base_failed(stats)
            score = model.probability(x) if len(model.leaf) else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(stats[k].astype(np.int64)) for k in STATS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))], ["doc_id", *STATS, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the trees keep.

    Rows are judged one by one, so null and repeated ids and repeated rows do no
    harm; null and empty texts fail the rules; an empty table gives no rows.
    """
    model = train(docs, labels)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            stats, x = document_stats(b.column("text"))
            score = model.probability(x) if len(model.leaf) else np.ones(len(x))
            yield b.filter(pa.array(~base_failed(stats) & (score >= keep_from)))

    return docs.mapInArrow(keep, schema)
