"""Phrase collocations by sampling: proposals and their negative border are counted over all rows, until closed.

A sample of the documents proposes phrases: word runs that are frequent in it
at a lowered threshold.  A pass over all documents counts every phrase whose
shorter parts (without its first word, without its last) are both proposed:
the proposals and their negative border.  No phrase outside can be frequent
unless one of its parts is a frequent phrase that was not proposed; where such
border failures are found they join the proposals, and a further pass counts
what they open up and no pass has counted before.  Words are all in the border
of the first pass.

Passes count 64-bit hashes, which may only overrate a phrase; a last pass
counts the texts of those that reached the threshold, so results do not depend
on hashes.  Which phrases are proposed travels as a bitmap of fixed size: where
it fills up, more phrases are counted and the results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, slices, written
from .textscan import U64, constants, scan, segment_hash, splitmix

# Fixed values of the contract: what parts pieces, what parts words, and the thresholds.
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BREAKS = b" \t"
MIN_COUNT = 10
MAX_WORDS = 3
INSIDE_PERCENT = 50
TOP = 2000
NO_LANG = "und"

#: One document in so many is in the sample; its threshold is this share of the expected count, 2 at least.
SAMPLE_SHARE = 8
LOWERED = 0.8
#: Parts of a lang that are ranked apart before its first phrases are.
RANK_PARTS = 16
#: Bits of the bitmap of proposals (8 MB).
BITS = 1 << 26
_CHUNK = 1 << 15
_LEVELS = 8  # the lowest three bits of a hash tell the number of words
_SLICE = 2 << 20

_PIECE = np.zeros(256, bool)
_PIECE[list(PIECE_BREAKS)] = True
_BREAK = _PIECE.copy()
_BREAK[list(WORD_BREAKS)] = True


def _phrases(batch: pa.RecordBatch, max_words: int):
    """Words of a batch (lang, text), and for 1 to max_words words (hashes, whether the run lies in one piece), by first word."""
    s = scan(batch.column("text"), lower=True, space=_BREAK)
    n, doc = len(s.start), s.doc_of_word()
    lang_data = [x.encode() for x in batch.column("lang").to_pylist()]
    border = np.concatenate(([0], np.cumsum([len(x) for x in lang_data], dtype=np.int64)))
    lang_hash = segment_hash(np.frombuffer(b"".join(lang_data), np.uint8), border[:-1], border[1:], seed=51)
    one = splitmix(segment_hash(s.data, s.start, s.end, seed=52) ^ lang_hash[doc])
    # words i and i + 1 follow each other in a piece
    piece = np.cumsum(_PIECE[s.data], dtype=np.int32)[s.start] if n else np.zeros(0, np.int64)
    follows = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    mixed, whole, out = one, np.ones(n, bool), []
    factor = constants(1, 53)[0]
    for m in range(1, max_words + 1):
        if m > 1:
            if n < m:
                break
            whole = whole[:-1] & follows[m - 2 :]
            mixed = splitmix(mixed[:-1] * factor + one[m - 1 :])
        out.append(((mixed & ~U64(_LEVELS - 1)) | U64(m), whole))
    return s, doc, out


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> U64(3)) & U64(8 * len(bits) - 1)
    return (bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0


def _counted(levels: list, known: np.ndarray | None, before: np.ndarray | None) -> Iterator[np.ndarray]:
    """For 2 words and more, which runs have both parts known now, but not both before."""
    for (parts, _), (hashes, whole) in zip(levels, levels[1:], strict=False):
        take = whole.copy()
        if known is not None:
            now = _is_set(known, parts)
            take &= now[:-1][: len(hashes)] & now[1:][: len(hashes)]
        if before is not None:
            was = _is_set(before, parts)
            take &= ~(was[:-1][: len(hashes)] & was[1:][: len(hashes)])
        yield take


def _count_hashes(docs: DataFrame, max_words: int, known, before, words: bool) -> DataFrame:
    """(h, n): how often each phrase of this pass occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None if known is None else np.frombuffer(known.value, np.uint8)
        then = None if before is None else np.frombuffer(before.value, np.uint8)
        for b in slices(batches, "text", _SLICE):
            levels = _phrases(b, max_words)[2]
            if not levels:
                continue
            parts = [levels[0][0]] if words else []
            parts += [hashes[take] for (hashes, _), take in zip(levels[1:], _counted(levels, now, then), strict=False)]
            found, n = np.unique(np.concatenate([*parts, np.zeros(0, U64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _texts(s, first: np.ndarray, m: int) -> pa.Array:
    """The m words from each of the given ones on, joined by single spaces."""
    at = (first[:, None] + np.arange(m)).ravel()
    size = (s.end - s.start)[at] + np.tile(np.arange(m) < m - 1, len(first))
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - size - s.start[at], size)
    out = np.append(s.data, np.uint8(0))[place]
    gaps = np.arange(len(at)) % m < m - 1
    out[ends[gaps] - 1] = 32
    border = np.concatenate(([0], ends[m - 1 :: m])).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(border.tobytes()), pa.py_buffer(out.tobytes())])


def _count_texts(docs: DataFrame, max_words: int, wanted) -> DataFrame:
    """(words, lang, phrase, n): exact counts of the phrases that the bitmap lets through; words = 0 counts all words of a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        names = ["words", "lang", "phrase", "n"]
        for b in slices(batches, "text", _SLICE):
            s, doc, levels = _phrases(b, max_words)
            lang = b.column("lang")
            all_words = pa.array(np.diff(s.first))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lang), np.int32)), lang, pa.array([""] * len(lang), pa.string()), all_words], names)
            for m, (hashes, whole) in enumerate(levels, 1):
                at = np.flatnonzero(whole)
                at = at[_is_set(bits, hashes[at])]
                _, one, n = np.unique(hashes[at], return_index=True, return_counts=True)
                first = at[one]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), m, np.int32)), lang.take(pa.array(doc[first])), _texts(s, first, m), pa.array(n.astype(np.int64))], names)

    counts = docs.mapInArrow(run, "words int, lang string, phrase string, n long")
    return counts.groupBy("words", "lang", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a table of hashes, of fixed size however many there are."""
    place = F.pmod(F.shiftright("h", 3), F.lit(bits))
    chunk = min(_CHUNK, bits)
    rows = hashes.select(F.floor(place / chunk).cast("int").alias("chunk"), F.pmod(place, F.lit(chunk)).alias("at")).groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)[: chunk // 8]
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, share: int = SAMPLE_SHARE, bits: int = BITS) -> DataFrame:
    """(words, lang, phrase, n) of all phrases of 1 to max_words words with n >= min_count; words = 0 has a lang's number of words.

    share: one document in so many proposes phrases; 0 for no sample, so that
    all are found through border failures.  Neither it nor `bits` changes rows.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = np.zeros(bits // 8, np.uint8)
    if share:
        sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        lowered = max(2, int(min_count * LOWERED / share))
        known = _bitmap(_count_hashes(sample, max_words - 1, None, None, True).where(F.col("n") >= lowered), bits)
    before, tables, wanted = None, [], np.zeros_like(known)
    while True:
        shared = context.broadcast(known.tobytes())
        counts = _count_hashes(texts, max_words, shared, before, before is None).where(F.col("n") >= min_count)
        tables.append(written(counts.select("h"), "phrase-hashes"))
        wanted |= _bitmap(tables[-1], bits)
        found = _bitmap(tables[-1].where(F.pmod("h", F.lit(_LEVELS)) < max_words), bits)
        if not (found & ~known).any():
            break
        known, before = known | found, shared
    drop(*tables)
    counts = _count_texts(texts, max_words, context.broadcast(wanted.tobytes()))
    return counts.where((F.col("n") >= min_count) | (F.col("words") == 0))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT, share: int = SAMPLE_SHARE, bits: int = BITS) -> DataFrame:
    """The first `top` collocations of each lang: lang, rank, phrase, a, l, r, n, score.

    A null lang counts as `und`, a null text as empty.  Repeated rows and ids
    count as often as they are there; null ids do no harm; an empty table, or
    one without frequent phrases, gives no rows; further columns are not read.
    Ties of scores and counts go by the bytes of the phrase.
    """
    counts = written(frequent_phrases(docs, min_count, max_words, share, bits), "phrase-counts")
    part = counts.where("words between 1 and %d" % (max_words - 1)).select("lang", "phrase", "n")
    cand = counts.where("words >= 2").select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("tail"))
    cut = cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cut = cut.select("lang", "phrase", "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    shorter = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = cand.where("words >= 3").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    # the first of each of a fixed number of parts, then of these: a lang never meets in one task
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    parts = ranked(free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))), "lang", "part")
    first = ranked(parts.drop("rank", "part"), "lang")
    n = counts.where("words = 0").select("lang", "n")
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
