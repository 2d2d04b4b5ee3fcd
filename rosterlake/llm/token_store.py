"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A store is a folder of files in ascending order of doc_id, with a table of
ranks and a manifest.  A file is one line of JSON (sizes), then the document
table, the control bytes and the data bytes.  The control byte of four ids
holds their byte counts (two bits each), the data bytes are the little-endian
ranks in one to four bytes, so frequent ids take one byte; a decoder looks the
control bytes up in a table and gathers all values at once with numpy.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import commit, drop, new_dir, put_temporary, range_shards, read_file, slices, written
from .textscan import constants, segment_hash, text_bytes

# Fixed values of the contract.
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"

#: Ids of a file, about; a longer document has a file to itself.
IDS_PER_FILE = 4 << 20
#: Encoded words that a worker goes on remembering more until, at about 30 bytes each.
MEMORY = 500_000
#: Words of more bytes are encoded each time.
LONG = 64
#: Words given to the library at once.
PIECE = 4096

LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], 1).astype(np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes); the last control byte is padded with zero codes."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of consecutive documents of `counts` ids each, whose control bytes are padded document by document."""
    quads = -(-counts // 4)
    length = LENGTHS[control].ravel()
    place = np.arange(counts.sum()) + np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts), counts)
    length = length[place]
    at = np.cumsum(length) - length
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTER = _bytes(bytes([*range(65, 91), *range(97, 123)]))
_PUNCTUATION = _bytes(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_OTHER_SPACE = _bytes(bytes([9, 11, 12, 13, 28, 29, 30, 31]))


def oddly_spaced(data: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Documents with white space other than single spaces and line breaks between other characters."""
    n, size = len(doc_start) - 1, len(data)
    space = (data == 32) | (data == 10)
    bad = _OTHER_SPACE[data]
    bad[1:] |= space[1:] & space[:-1]
    full = doc_start[:-1] < doc_start[1:]
    heads, tails = doc_start[:-1][full], doc_start[1:][full] - 1
    bad[heads] = space[heads] | _OTHER_SPACE[data[heads]]
    bad[tails] |= space[tails]
    # white space outside ASCII, in UTF-8
    padded = np.append(data, np.zeros(2, np.uint8))
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    x, y, z = padded[at], padded[at + 1], padded[at + 2]
    wide = ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    wide |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    bad[at[wide]] = True
    out = np.zeros(n, bool)
    where = np.flatnonzero(bad) if size else np.zeros(0, np.int64)
    out[np.searchsorted(doc_start, where, side="right") - 1] = True
    return out


class Encoder:
    """Encodes texts with the tokenizers library, word by word where that is the same.

    In a byte-level BPE vocabulary no piece crosses a single space or line break
    between two other characters, or goes on from a letter to punctuation, so
    texts are cut there; a word is encoded once and found again by its 64-bit
    hash, in this batch and in later ones.  Texts with other spacing, or with
    the string of an added token, are encoded whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memory = memory
        # known words: hashes ascending, and their ids from first to first + count
        self.hashes, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a few at a time, as the library's results are large."""
        parts = (texts[k : k + PIECE] for k in range(0, len(texts), PIECE))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 borders) of all texts; null counts as empty."""
        data, doc_start = text_bytes(column)
        n = len(doc_start) - 1
        odd = oddly_spaced(data, doc_start)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(doc_start, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        text = lambda a, b: raw[a:b].decode()
        begins = np.zeros(len(data), bool)
        if len(data):
            line = data == 10
            begins = (data == 32) | line
            begins[1:] |= line[:-1] | (_LETTER[data[:-1]] & _PUNCTUATION[data[1:]])
            begins[doc_start[:-1][doc_start[:-1] < doc_start[1:]]] = True
            odd_bytes = np.repeat(odd, np.diff(doc_start))
            begins &= ~odd_bytes
            # an odd text is one word of its own
            begins[doc_start[:-1][odd]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        # long words and whole texts are not looked up: their place stands for them
        long = end - start > LONG
        keys = segment_hash(data, start, np.where(long, start, end))
        keys[long] = constants(int(long.sum()), 41)
        hashes, one, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = (self.hashes[place] == hashes) & ~long[one] if len(self.hashes) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        encoded = self.whole([text(a, b) for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
        lengths = np.array([len(x) for x in encoded], np.int64)
        fresh = np.concatenate([*encoded, np.zeros(0, np.uint32)])
        table = np.concatenate((self.ids, fresh))
        first, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        first[known], count[known] = self.first[place[known]], self.count[place[known]]
        first[new], count[new] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        if len(self.hashes) < self.memory:
            short = ~long[one[new]]
            kept = new[short]
            order = np.argsort(np.concatenate((self.hashes, hashes[kept])), kind="stable")
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count[kept]) - count[kept]))[order]
            self.count = np.concatenate((self.count, count[kept]))[order]
            self.hashes = np.concatenate((self.hashes, hashes[kept]))[order]
            self.ids = np.concatenate((self.ids, fresh[np.repeat(short, lengths)]))
        size = count[back]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = table[np.arange(total) + np.repeat(first[back] - (ends - size), size)]
        border = np.concatenate(([0], ends))[np.searchsorted(start, doc_start)]
        assert len(border) == n + 1
        return flat, border


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoder(path).vocabulary <= 1 << 16 else np.uint32
        for b in slices(batches, "text"):
            ids, first = encoder(path).encode(b.column("text"))
            rows = [np.append(ids[x:y], END_ID).astype(kind).tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first) + 1), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return tokenize


def _count(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, "ids"):
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), kind)
            seen = np.bincount(ids)
            if len(seen) > len(total):
                total = np.append(total, np.zeros(len(seen) - len(total), np.int64))
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    return count


def _encode(kind: str, rank_of: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            control, data = zip(*(encode_ranks(rank_of[np.frombuffer(x, kind)]) for x in b.column("ids").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(control, pa.binary()), pa.array(data, pa.binary()), b.column("shard")], ["doc_id", "n_tokens", "control", "data", "shard"])

    return encode


def _write(folder: str, ids_per_file: int):
    """Files of each shard of a stream sorted by (shard, doc_id); a manifest row for each."""

    def flush(shard: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
        docs, counts, control, data = zip(*rows, strict=True)
        missing = [i for i, d in enumerate(docs) if d is None]
        body = [np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(counts, "<i8").tobytes(), *control, *data]
        head = {"documents": len(docs), "ids": sum(counts), "control": sum(map(len, control)), "data": sum(map(len, data)), "null_ids": missing}
        name = f"ids-{shard:08d}-{part:06d}.bin"
        temp = put_temporary(folder, name, [json.dumps(head).encode() + b"\n", *body])
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "documents": pa.array([len(docs)]), "n_ids": pa.array([sum(counts)]), "temp_name": [temp], "file_name": [name]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held, n = None, 0, [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "control", "data")), strict=True):
                if held and (row[0] != shard or n + row[2] > ids_per_file):
                    yield flush(shard, part, held)
                    part, held, n = part + 1, [], 0
                if row[0] != shard:
                    shard, part = row[0], 0
                held.append(row[1:])
                n += row[2]
        if held:
            yield flush(shard, part, held)

    return write


_MANIFEST = "shard int, part int, documents long, n_ids long, temp_name string, file_name string"


def read_ids(folder: str, name: str, token_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each, all ids) of a file of a store."""
    raw = read_file(folder, name)
    line = raw.index(b"\n")
    head = json.loads(raw[:line])
    n, at = head["documents"], line + 1
    docs = np.frombuffer(raw, "<i8", n, at).tolist()
    for i in head["null_ids"]:
        docs[i] = None
    counts = np.frombuffer(raw, "<i8", n, at + 8 * n)
    at += 16 * n
    ranks = decode_ranks(np.frombuffer(raw, np.uint8, head["control"], at), np.frombuffer(raw, np.uint8, head["data"], at + head["control"]), counts)
    return docs, counts, token_of[ranks]


def write_store(docs: DataFrame, tokenizer_path: str, ids_per_file: int = IDS_PER_FILE) -> tuple[str, DataFrame]:
    """Write docs (doc_id, text, ...) as a token-id store; returns its folder and manifest."""
    spark = docs.sparkSession
    folder = new_dir(spark, "token-store")
    tokens = written(docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path), "doc_id long, n_tokens long, ids binary"), "tokens")
    kind = "<u2" if encoder(tokenizer_path).vocabulary <= 1 << 16 else "<u4"
    # as many rows as the vocabulary has ids, at most
    counts = tokens.select("ids").mapInArrow(_count(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "token"], ascending=[False, True])
    token_of = counts["token"].to_numpy().astype("<u4")
    rank_of = np.zeros(int(token_of.max()) + 1 if len(token_of) else 1, np.uint32)
    rank_of[token_of] = np.arange(len(token_of))
    fs_name = put_temporary(folder, "ranks", [token_of.tobytes()])
    shaped, shards = range_shards(tokens, "doc_id", F.col("n_tokens"), 2 * ids_per_file)
    encoded = shaped.select("doc_id", "n_tokens", "ids", "shard").mapInArrow(_encode(kind, rank_of), "doc_id long, n_tokens long, control binary, data binary, shard int")
    ordered = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "data")
    files = written(ordered.mapInArrow(_write(folder, ids_per_file), _MANIFEST), "files")
    ranks = spark.createDataFrame([(-1, 0, 0, 0, fs_name, "ranks.bin")], _MANIFEST)
    manifest = commit(files.unionByName(ranks), folder)
    drop(tokens, files)
    return folder, manifest.where("shard >= 0")


def read_store(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a store."""
    token_of = np.frombuffer(read_file(folder, "ranks.bin"), "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column("file_name").to_pylist(), b.column("before").to_pylist(), strict=True):
                docs, counts, ids = read_ids(folder, name, token_of)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each file: where it starts, in the order of the store
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    wide = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("file_name", "before").repartition(wide, "file_name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_documents(docs: DataFrame, tokenizer_path: str, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write docs to a store and read it back: doc_id, start, n_tokens, ids_crc32; one row per row.

    A null or empty text is the end id alone.  Rows that repeat an id follow
    each other by length, then by content; null ids come first.  An empty table
    gives an empty store and no rows.
    """
    return read_store(*write_store(docs, tokenizer_path, ids_per_file))
