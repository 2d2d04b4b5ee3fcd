"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document.  Its anchor is the
smallest hash of the GRAM-word runs in it, so equal windows have equal anchors,
and a document has far fewer anchors than windows.  The index holds sorted
immutable runs of (anchor, document), bucketed by anchor: a new batch becomes a
run, is merge-joined with itself and with every earlier run without a shuffle,
and runs are compacted into one when there are too many.  Only documents that
share an anchor are read again: of their windows with shared anchors two
independent 64-bit hashes over all words are compared, which verifies the
anchors, and words under windows that start earlier elsewhere are removed.

Documents whose words equal an earlier document's are settled first (all their
windows start earlier there), so large groups of copies never meet in a task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .membership import maybe_members
from .quality_rules import repeated_in_document
from .storage import drop, new_dir, open_fs, put_temporary, read_file, remove_dir, slices, written
from .textscan import U64, Scan, covered, joined, per_doc, scan, sliding, sorted_unique_by_doc, splitmix, windows, word_hash

# Fixed value of the contract.
WINDOW = 20
GRAM = 8
MAX_RUNS = 4
NO_ID = -(2**63)
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each word, and whether there is one."""
    grams, _ = windows(hashes, first, GRAM, seed=31)
    _, whole = windows(hashes, first, WINDOW, seed=32)
    return sliding(grams, WINDOW - GRAM + 1, np.minimum), whole


def kept_digests(s: Scan, keep: np.ndarray) -> list[str]:
    out, at = joined(s, keep)
    raw = memoryview(out)
    return [hashlib.sha256(raw[x : y - 1] if y > x else b"").hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        s = scan(b.column("text"))
        hashes, doc = word_hash(s), s.doc_of_word()
        anchor, whole = anchors(hashes, s.first)
        values, first = sorted_unique_by_doc(anchor[whole], doc[whole], b.num_rows)
        # an index run holds an anchor once a document, so windows that recur inside one are noted here
        at = np.flatnonzero(whole)
        at = at[repeated_in_document(windows(hashes, s.first, WINDOW, seed=33)[0][at], doc[at])]
        again, again_first = sorted_unique_by_doc(anchor[at], doc[at], b.num_rows)
        keys = kept_digests(s, np.ones(len(s.start), bool))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(s.first)), pa.array(keys), _lists(values.view(np.int64), first, pa.int64()), _lists(again.view(np.int64), again_first, pa.int64())], ["id", "n_words", "key", "anchors", "inner"])


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a shared anchor: of equal ones in a slice only the earliest goes on; starts of the others are listed."""
    names = ["w1", "w2", "fresh", "id", "pos", "starts"]
    for b in slices(batches, "text"):
        s = scan(b.column("text"))
        hashes, doc = word_hash(s), s.doc_of_word()
        anchor, whole = anchors(hashes, s.first)
        at = np.flatnonzero(whole)
        column = b.column("shared")
        salt = lambda d: d.astype(U64) * U64(0x9E3779B97F4A7C15)
        lengths = np.asarray(column.value_lengths())
        wanted = splitmix(np.asarray(column.flatten()).view(U64) ^ salt(np.repeat(np.arange(b.num_rows), lengths)))
        at = at[np.isin(splitmix(anchor[at] ^ salt(doc[at])), wanted)]
        # two hashes of the window that share no part: words are hashed anew for the second
        w1, w2 = (windows(h, s.first, WINDOW, seed=k)[0][at] for h, k in ((hashes, 33), (word_hash(s, seed=35), 34)))
        ids, fresh = b.column("id").to_numpy(), np.asarray(b.column("fresh")).astype(bool)
        d, pos = doc[at], at - s.first[doc[at]]
        order = np.lexsort((pos, ids[d], fresh[d], w2, w1))
        same = np.zeros(len(order), bool)
        same[1:] = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        head = order[~same]
        # a row that repeats the position of its group's head (a repeated id) is no later one
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(order), bool)
        later[order] = same & ~((ids[d[order]] == ids[d[lead]]) & (pos[order] == pos[lead]) & (fresh[d[order]] == fresh[d[lead]]))
        yield pa.RecordBatch.from_arrays([pa.array(w1[head].view(np.int64)), pa.array(w2[head].view(np.int64)), pa.array(fresh[d[head]]), pa.array(ids[d[head]]), pa.array(pos[head].astype(np.int32)), pa.nulls(len(head), pa.list_(pa.int32()))], names)
        gone = np.flatnonzero(later & fresh[d])
        if len(gone):
            first = np.searchsorted(d[gone], np.arange(b.num_rows + 1))
            some = np.flatnonzero(np.diff(first))
            lists = _lists(pos[gone].astype(np.int32), first, pa.int32()).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), pa.int64()) for _ in range(2)), pa.array(np.ones(len(some), bool)), pa.array(ids[some]), pa.nulls(len(some), pa.int32()), lists], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        s = scan(b.column("text"))
        column = b.column("starts")
        lengths = np.asarray(column.value_lengths())
        starts = np.asarray(column.flatten()).astype(np.int64) + np.repeat(s.first[:-1], lengths)
        words = np.repeat(s.first[1:], lengths)
        gone = covered(starts[starts + WINDOW <= words], WINDOW, len(s.start))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(kept_digests(s, np.ones(len(s.start), bool))), pa.array(per_doc(gone, s.first)), pa.array(kept_digests(s, ~gone))], ["id", "key", "n_removed", "kept_sha256"])


_RUN = "id long, anchor long"
_KEYS = "key string, first_id long"


class FingerprintIndex:
    """Runs of (anchor, document) and of text digests of all documents added so far.

    folder: where the index lives; one that is there already is opened as its
    newest manifest has it, so a later session adds to what an earlier one
    built.  Manifests appear under their names when all they list is written,
    so a job that dies leaves the version before.  One writer at a time.
    Without a folder the index is scratch and goes with `close`.
    """

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS, folder: str | None = None):
        self.spark, self.max_runs, self.lasting = spark, max_runs, folder is not None
        self.folder = folder.rstrip("/") if folder else new_dir(spark, "fingerprints")
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.runs: list[tuple[str, str]] = []
        self.keys: list[DataFrame] = []
        if self.lasting:
            self._open()

    def _open(self) -> None:
        fs, root = open_fs(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        numbers = sorted(int(f.base_name.split(".")[0].split("-")[1]) for f in found if f.base_name.startswith("manifest-"))
        if not numbers:
            return
        held = json.loads(read_file(self.folder, f"manifest-{numbers[-1]}.json"))
        self.version, self.buckets = numbers[-1], held["buckets"]
        self.runs = [(self._named(path), path) for path in held["runs"]]
        self.keys = [self._keys_at(path) for path in held["keys"]]

    def _named(self, path: str) -> str:
        """Register the files of a run as a bucketed table again."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        columns = _RUN.replace("long", "bigint")
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _keys_at(self, path: str) -> DataFrame:
        out = self.spark.read.schema(_KEYS).parquet(path)
        out.scratch_path = path
        return out

    def _write_keys(self, keys: DataFrame) -> DataFrame:
        path = f"{self.folder}/keys-{uuid.uuid4().hex}"
        keys.select("key", "first_id").write.option("compression", "zstd").parquet(path)
        return self._keys_at(path)

    def _commit(self) -> None:
        if not self.lasting:
            return
        self.version += 1
        body = json.dumps({"buckets": self.buckets, "runs": [path for _, path in self.runs], "keys": [k.scratch_path for k in self.keys]}).encode()
        name = f"manifest-{self.version}.json"
        temp = put_temporary(self.folder, name, [body])
        fs, root = open_fs(self.folder)
        fs.move(f"{root}/{temp}", f"{root}/{name}")

    def _run(self, rows: DataFrame) -> tuple[str, str]:
        """Write a sorted immutable run: a table bucketed by anchor."""
        name, path = f"fingerprints_{uuid.uuid4().hex}", f"{self.folder}/run-{uuid.uuid4().hex}"
        dealt = rows.select("id", "anchor").repartition(self.buckets, "anchor").sortWithinPartitions("anchor")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove_dir(self.spark, run[1])

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) < 2:
            return
        rows = self.spark.table(self.runs[0][0])
        for name, _ in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        merged = self._run(rows)
        keys = self.keys[0]
        for more in self.keys[1:]:
            keys = keys.unionByName(more)
        keys = self._write_keys(keys)
        old = self.runs, self.keys
        self.runs, self.keys = [merged], [keys]
        self._commit()
        # no manifest that is opened from now on names these
        for run in old[0]:
            self._drop(run)
        drop(*old[1])

    def close(self) -> None:
        """Let go of the tables; a scratch index is deleted, a lasting one stays in its folder."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        if not self.lasting:
            remove_dir(self.spark, self.folder)
        self.runs, self.keys = [], []

    def add(self, batch: DataFrame, archive: DataFrame) -> DataFrame:
        """Deduplicate a batch (doc_id, text) against itself and all earlier ones, and add it to the index.

        archive: the documents of all earlier batches, read again only where
        they share an anchor with this one.  Returns doc_id, n_words, n_removed,
        kept_sha256; earlier batches count as earlier, whatever their ids.
        """
        shaped = lambda df: df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
        batch, archive = shaped(batch), shaped(archive)
        described = written(batch.mapInArrow(_describe, "id long, n_words long, key string, anchors array<long>, inner array<long>"), "described")
        own = described.groupBy("key").agg(F.min("id").alias("first_id"))
        for past in self.keys:
            own = own.join(past, "key", "left_anti")
        own = self._write_keys(own)
        heads = described.join(own, "key").where(F.col("id") == F.col("first_id"))
        new = self._run(heads.select("id", F.explode("anchors").alias("anchor")))
        fresh = self.spark.table(new[0])
        # merge joins of bucketed, sorted runs: anchors that two documents have
        counted = fresh.groupBy("anchor").agg(F.count("*").alias("n"))
        twice = fresh.join(counted.where("n > 1"), "anchor", "left_semi").select("id", "anchor", F.lit(True).alias("fresh"))
        shared = twice
        for name, _ in self.runs:
            past = self.spark.table(name)
            shared = shared.unionByName(past.join(counted, "anchor", "left_semi").select("id", "anchor", F.lit(False).alias("fresh")))
            shared = shared.unionByName(fresh.join(past, "anchor", "left_semi").select("id", "anchor", F.lit(True).alias("fresh")))
        shared = shared.unionByName(heads.select("id", F.explode("inner").alias("anchor"), F.lit(True).alias("fresh")))
        touched = written(shared.groupBy("id", "fresh").agg(F.collect_set("anchor").alias("shared")), "touched")
        texts = batch.withColumn("fresh", F.lit(True)).unionByName(archive.withColumn("fresh", F.lit(False)))
        # a fixed-size bitmap keeps texts without a shared anchor out of the shuffle
        read = written(maybe_members(texts, "id", touched.select("id")).join(touched, ["id", "fresh"]), "texts")
        found = written(read.mapInArrow(_shared_windows, "w1 long, w2 long, fresh boolean, id long, pos int, starts array<int>"), "windows")
        place = F.struct("fresh", "id", "pos")
        # combined on the map side, so that no task gets all places of a frequent window
        firsts = found.where("w1 is not null").groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = found.where("fresh").join(firsts, ["w1", "w2"]).where(place > F.col("first"))
        starts = later.groupBy("id").agg(F.collect_list("pos").alias("starts")).unionByName(found.where("w1 is null").select("id", "starts"))
        starts = starts.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        cut = read.where("fresh").select("id", "text").join(starts, "id").mapInArrow(_cut, "id long, key string, n_removed long, kept_sha256 string")
        cut = written(cut.dropDuplicates(["id", "key"]), "cut")
        copies = (F.col("first_id").isNull() | (F.col("id") != F.col("first_id"))) & (F.col("n_words") >= WINDOW)
        joined_rows = described.drop("anchors", "inner").join(own, "key", "left").join(cut, ["id", "key"], "left")
        result = written(
            joined_rows.select(
                F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
                "n_words",
                F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(copies, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"),
            ),
            "result",
        )
        drop(described, touched, read, found, cut)
        self.keys.append(own)
        self.runs.append(new)
        self._commit()
        if len(self.runs) > self.max_runs:
            self.compact()
        return result


def remove_repeats(docs: DataFrame, batches: int = 3, max_runs: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256; one row per row.

    The table is added to a fresh index in batches of ascending doc_id and about
    equal numbers of rows; the result does not depend on where they are cut.  Null and empty texts have no
    words; rows that repeat an id start at the same place, so neither removes
    the other; a null id counts as the smallest.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = FingerprintIndex(spark, max_runs)
    # approximate places will do, but they must be whole: doubles pass 2**53 inexactly, which only moves a cut
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02)}) if batches > 1 else []
    out = None
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        past = F.lit(False) if a is None else F.col("doc_id").isNull() | (F.col("doc_id") < a)
        until = F.lit(True) if b is None else F.col("doc_id").isNull() | (F.col("doc_id") < b)
        part = index.add(docs.where(~past & until), docs.where(past))
        out = part if out is None else out.unionByName(part)
    index.close()
    return out
