"""SentencePiece encoding and decoding by a table of last tokens.

Of a model of merges, the encoding of every prefix of a text ends in one token
only.  An automaton gives the pieces that end at each place; the one among them
that the last token of the prefix before it tolerates (a pair-compatibility
test: no merge would have joined the two earlier) is stored, and the ids follow
by going back through the table.  The work is linear in the text.

Texts are cut where no piece of the model holds the two characters on either
side, so cuts never change the result; each part is encoded once and found
again by its bytes.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import slices
from .textscan import text_bytes

MODEL = "piece_bpe_32k.model"
# Fixed values of the format: the mark of a space, its UTF-8 bytes, and what an id without text decodes to.
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Encoded parts that a worker keeps; a bound on memory, not on results.
MEMORY = 600_000
PAIRS = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}[wire] if wire != 2 else number()
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """What encoding and decoding need of a model file; small, made once on the driver and broadcast."""

    name: str  # digest of the file
    ids: dict[str, int]  # pieces of text
    rank: dict[str, int]  # order of merges; single characters are there before any
    split: dict[str, tuple[str, str]]  # the two parts that a piece's last merge joins
    late: dict[str, float]  # pieces that share the lowest score: merged after all others, from the left
    byte_ids: list[int]
    eos: int
    text_of: list[bytes]  # what each id decodes to
    kind_of: np.ndarray  # 0 text, 1 byte, 2 nothing, 3 unknown
    joined: np.ndarray = field(repr=False, default=None)  # whether two characters stand side by side in a piece; from 128 on one class


def _last_split(piece: str, score: dict[str, float]) -> tuple[str, str] | None:
    """The parts joined by the last merge that makes the piece, or None if merges do not lead to it."""
    parts = list(piece)
    while len(parts) > 2:
        less = _merged_once(parts, score)
        if less is None:
            return None
        parts = less
    return tuple(parts) if len(parts) == 2 and piece in score else None


def _merged_once(parts: list[str], score: dict[str, float]) -> list[str] | None:
    found = [(-score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in score]
    if not found:
        return None
    i = min(found)[1]
    return [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Model:
    """Read a model file; ValueError where it is not of merges, or normalises beyond marking spaces."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    trainer = dict(_fields(b"".join(v for k, v in _fields(raw) if k == 2)))
    normal = dict(_fields(b"".join(v for k, v in _fields(raw) if k == 3)))
    # defaults of the format: a space before the text, no others dropped only if field 4 says so, spaces marked
    plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    if trainer.get(3) != 2 or trainer.get(24, 0) or not plain:
        raise ValueError("a model of merges that keeps white space is needed")
    n = sp.get_piece_size()
    text_of, kind_of, score, ids, byte_ids = [], np.zeros(n, np.int8), {}, {}, [-1] * 256
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            kind_of[i], value = 1, int(piece[3:5], 16)
            byte_ids[value] = i
            text_of.append(bytes([value]))
        elif sp.is_control(i):
            kind_of[i] = 2
            text_of.append(b"")
        elif sp.is_unknown(i):
            kind_of[i] = 3
            text_of.append(UNKNOWN_TEXT.encode())
        elif sp.is_unused(i):
            raise ValueError("a model with unused pieces")
        else:
            score[piece] = sp.get_score(i)
            ids[piece] = i
            text_of.append(piece.replace(SPACE, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("a model with a piece for each byte is needed")
    several = {p: s for p, s in score.items() if len(p) > 1}
    lowest = min(several.values(), default=0.0)
    late = {p: s for p, s in several.items() if s == lowest}
    late = late if len(late) > 1 else {}
    regular = {p: s for p, s in several.items() if p not in late}
    rank = {p: k for k, p in enumerate(sorted(regular, key=lambda p: -regular[p]))}
    split = {p: x for p in regular if (x := _last_split(p, regular)) is not None}
    # what the table relies on: distinct scores, parts merged before the whole, late pieces in no other
    in_order = all(rank[p] > rank.get(part, -1) for p, parts in split.items() for part in parts)
    if len(set(regular.values())) < len(regular) or not in_order or any(x in p for p in regular for x in late):
        raise ValueError("a model whose merges have no single order")
    joined = np.zeros((129, 129), bool)
    joined[128, 128] = True
    kind = lambda c: 32 if c == SPACE else min(ord(c), 128)
    for p in several:
        for a, b in zip(p, p[1:], strict=False):
            joined[kind(a), kind(b)] = True
    return Model(hashlib.sha256(raw).hexdigest(), ids, {p: rank[p] for p in split}, split, late, byte_ids, sp.eos_id(), text_of, kind_of, joined)


class Encoder:
    """Encodes texts of one worker; keeps what it learns of parts and pairs."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for p in model.split:
            self.automaton.add_word(p, p)
        self.any_piece = bool(model.split)
        if self.any_piece:
            self.automaton.make_automaton()
        self.late_starts = {p[:2] for p in model.late}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.counts, self.flat = array("i"), array("i")

    def compatible(self, a: str, b: str) -> bool:
        """Whether tokens a and b stay apart side by side.

        The merges that made them are undone from the latest back; at no earlier
        time may a merge across the border have come first.  Of equal ranks the
        left one does.
        """
        pair = (a, b)
        rank, split = self.model.rank, self.model.split
        limit, apart = len(rank), True
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                apart = False
                break
            left, right = rank.get(a, -1), rank.get(b, -1)
            if left < 0 and right < 0:
                break
            if left > right:
                limit, a = left, split[a][1]
            else:
                limit, b = right + 1, split[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = apart
        return apart

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text whose spaces are marked; characters that the model lacks stand for themselves."""
        last = ["", *text]
        if self.any_piece:
            done, compatible, pairs = 0, self.compatible, self.pairs
            for end, piece in self.automaton.iter(text):
                if end < done:
                    continue
                before = last[end + 1 - len(piece)]
                apart = pairs.get((before, piece)) if before else True
                if apart or apart is None and compatible(before, piece):
                    last[end + 1] = piece
                    done = end + 1
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return _merged_from_left(out, self.model.late) if any(x in text for x in self.late_starts) else out

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        ids, byte_ids = self.model.ids, self.model.byte_ids
        for t in self.tokens(text):
            i = ids.get(t)
            if i is None:
                out += [byte_ids[b] for b in t.encode()]
            else:
                out.append(i)
        return out

    def encode(self, column: pa.Array, end_id: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 borders) of all texts; null counts as empty."""
        column = pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))
        data, border = text_bytes(column)
        n = len(border) - 1
        filled = border[:-1] < border[1:]
        begins = np.zeros(len(data), bool)
        if len(data):
            kind = np.minimum(data, 128)
            begins[1:] = ~self.model.joined[kind[:-1], kind[1:]]
            begins[1:] &= (data[1:] & 0xC0) != 0x80
            begins[border[:-1][filled]] = True
        start = np.flatnonzero(begins)
        ends = np.append(start[1:], len(data))
        raw, known = data.tobytes(), self.known
        if len(known) > MEMORY:
            self.forget()
        parts = [raw[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        for part in set(parts) - known.keys():
            ids = self.ids(part.decode().replace(" ", SPACE))
            known[part] = len(self.counts)
            self.counts.append(len(ids))
            self.flat.extend(ids)
        which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        counts = np.frombuffer(self.counts, np.intc).astype(np.int64) if self.counts else np.zeros(0, np.int64)
        first = np.cumsum(counts) - counts
        took = counts[which]
        # one slot more after each document's parts for the end id
        at_doc = np.searchsorted(start, border)
        total = np.concatenate(([0], np.cumsum(took)))[at_doc]
        out_border = total + (np.arange(n + 1) if end_id else 0)
        flat = np.array(np.frombuffer(self.flat, np.intc), np.int32) if self.flat else np.zeros(0, np.int32)
        picked = flat[np.arange(int(took.sum())) + np.repeat(first[which] - (np.cumsum(took) - took), took)] if len(flat) else np.zeros(0, np.int32)
        return (np.insert(picked, total[1:], self.model.eos).astype(np.int32) if end_id else picked), out_border


def _merged_from_left(tokens: list[str], late: dict[str, float]) -> list[str]:
    """Merge neighbours whose pieces all have one score, always the leftmost pair that can be.

    What lies left of a merge can only change through the part just made, so a
    stack of the tokens so far is enough.
    """
    out: list[str] = []
    for t in tokens:
        out.append(t)
        while len(out) > 1 and out[-2] + out[-1] in late:
            t = out.pop()
            out[-1] += t
    return out


class Decoder:
    """Turns ids back into text."""

    def __init__(self, model: Model):
        lengths = np.array([len(x) for x in model.text_of], np.int64)
        self.data = np.frombuffer(b"".join(model.text_of), np.uint8)
        self.start, self.length, self.kind = np.cumsum(lengths) - lengths, lengths, model.kind_of
        # ids whose text begins with the space that encoding puts first
        self.spaced = np.array([x.startswith(b" ") for x in model.text_of]) & (model.kind_of == 0)

    def decode(self, ids: np.ndarray, border: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Text of each list of ids, as UTF-8; ids outside the model raise IndexError."""
        length = self.length[ids]
        ends = np.cumsum(length)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length - self.start[ids], length)
        raw = self.data[place].tobytes()
        at = np.concatenate(([0], ends))[border]
        # the first id with text gives up its leading space
        texts = np.flatnonzero(length > 0)
        first = np.searchsorted(texts, border[:-1])
        cut = np.zeros(len(border) - 1, np.int64)
        some = np.flatnonzero((first < len(texts)) & (np.append(texts, 0)[np.minimum(first, len(texts))] < border[1:]))
        if len(some):
            cut[some] = self.spaced[ids[texts[first[some]]]]
        out = [raw[a + c : b] for a, b, c in zip(at[:-1].tolist(), at[1:].tolist(), cut.tolist(), strict=True)]
        kind = self.kind[ids]
        if (kind == 1).any():
            for k, x in enumerate(out):
                own = kind[border[k] : border[k + 1]]
                # an id without text parts the bytes on its sides
                if (own[:-1] == 2).any() or not _is_text(x):
                    out[k] = self.with_broken_bytes(ids[border[k] : border[k + 1]], int(cut[k]))
        return out

    def with_broken_bytes(self, ids: np.ndarray, cut: int) -> bytes:
        """Text of ids whose byte pieces are no UTF-8: each byte that starts no character gives a mark."""
        out, held = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.kind[i] == 1:
                held += self.data[self.start[i] : self.start[i] + 1].tobytes()
                continue
            while held:
                size = next((k for k in (1, 2, 3, 4) if len(held) >= k and _is_text(held[:k])), 0)
                out.append(held[:size] if size else "�".encode())
                held = held[max(size, 1) :]
            if i is not None:
                out.append(self.data[self.start[i] : self.start[i] + self.length[i]].tobytes())
        return b"".join(out)[cut:]


def _is_text(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


_workers: dict[str, tuple[Encoder, Decoder]] = {}


class _Shared:
    """A model on its way to the workers, which keep their encoder and decoder between tasks."""

    def __init__(self, df: DataFrame, path: str):
        model = load(path)
        self.name = model.name
        self.held = df.sparkSession.sparkContext.broadcast(model)

    def tools(self) -> tuple[Encoder, Decoder]:
        if self.name not in _workers:
            _workers.clear()
            _workers[self.name] = (Encoder(self.held.value), Decoder(self.held.value))
        return _workers[self.name]


def _ids_array(ids: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids))


def encode_documents(docs: DataFrame, model_path: str, end_id: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs, as the library encodes its whole text.

    A null or empty text has the end id alone (or no ids).  Rows are taken one
    by one: null and repeated ids, repeated rows and further columns do no harm;
    an empty table gives no rows.  Nothing is shuffled.
    """
    shared = _Shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.tools()[0]
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _ids_array(*encoder.encode(b.column("text"), end_id))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none and give an empty text."""
    shared = _Shared(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.tools()[1]
        for b in slices(batches, "ids"):
            ids = b.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decoder.decode(flat, np.concatenate(([0], np.cumsum(counts))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id) and the text they decode to, in one pass; defined as `encode_documents`."""
    shared = _Shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.tools()
        for b in slices(batches, "text"):
            ids, border = encoder.encode(b.column("text"))
            texts = pa.array(decoder.decode(ids, border), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _ids_array(ids, border), texts], ["doc_id", "ids", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows (doc_id, ids, text)."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
