"""Vectorised word scanning over Arrow text columns (numpy, no per-word Python).

A word is a maximal run of bytes other than space and 0x09-0x0D; those are
ASCII, so word borders in UTF-8 bytes are word borders in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudorandom odd 64-bit numbers that depend on the seed only."""
    return splitmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + splitmix(np.array([seed], U64))) | U64(1)


#: Blocks of 8 bytes that `segment_hash` mixes in numpy steps; longer ranges are hashed one by one.
BLOCKS = 32
_LAST = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), (1 << 64) - 1], U64)


@dataclass
class Scan:
    """Words of a run of documents: bytes, byte borders of documents and words, first word of each document."""

    data: np.ndarray
    doc_start: np.ndarray  # n + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 word offsets

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        """Bytes of word i."""
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def scan(column: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Scan:
    """Find the words of every document of the column; `lower` lower-cases A-Z first; `space` flags the ASCII bytes that part words."""
    data, off = text_bytes(column)
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Scan(data, off, none, none, np.zeros(len(off), np.int64))
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = inside[heads]
    ends[heads[1:] - 1] = inside[heads[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Scan(data, off, start, end, np.searchsorted(start, off))


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 12) -> np.ndarray:
    """64-bit hash of each byte range.

    Blocks of 8 bytes are mixed in one after the other, each step a bijection
    of the block, so ranges of one block never collide and no relation between
    texts makes longer ones do so; seeds give independent hashes.
    """
    length = end - start
    key = constants(2, seed)
    out = splitmix(length.astype(U64) * key[0] + key[1])
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    long = length > 8 * BLOCKS
    at, k = np.flatnonzero((length > 0) & ~long), 0
    while len(at):
        left = length[at] - 8 * k
        block = eight[start[at] + 8 * k].view("<u8").ravel() & _LAST[np.minimum(left, 8)]
        out[at] = splitmix((out[at] ^ block) * key[0])
        at, k = at[left > 8], k + 1
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.tobytes()).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_hash(s: Scan, seed: int = 12) -> np.ndarray:
    return segment_hash(s.data, s.start, s.end, seed)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each word on, and whether that window lies in one document."""
    n = len(hashes)
    out, ok = np.zeros(n, U64), np.zeros(n, bool)
    if n >= size:
        m = n - size + 1
        for i, c in enumerate(constants(size, seed)):
            out[:m] += hashes[i : i + m] * c
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        ok = left >= size
    return splitmix(out), ok


def sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """op (minimum or maximum) over values[i : i + size]; as long as the values, short at the end."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:])
        have += step
    return out


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags (one for each word or byte) by document, given n + 1 borders."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(flags, first[:-1][full], dtype=np.int64)
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words from one of the starts."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + size, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def sorted_unique_by_doc(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, ascending, and n + 1 borders."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[fresh], np.searchsorted(o[fresh], np.arange(n + 1))


def joined(s: Scan, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each document, joined by single spaces, and n + 1 borders.

    Each document's part ends in one space more; an empty part has none.
    """
    start, length = s.start[keep], (s.end - s.start)[keep] + 1
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - length - start, length)
    out = np.append(s.data, np.uint8(0))[place]
    out[ends - 1] = 32
    per_word = np.zeros(len(s.start), np.int64)
    per_word[keep] = length
    return out, np.concatenate(([0], np.cumsum(per_doc(per_word, s.first))))
