"""Words of many texts at once, as numpy arrays over Arrow buffers.

Every ``mapInArrow`` body of this subpackage goes through :func:`chunks`, which
cuts an Arrow batch into runs of rows of about ``limit`` bytes, so that memory in
a task depends on that limit (or on the one longest text), not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18   # arrays over a chunk take some 60 bytes a byte of text
WIDE = 1 << 20          # where a chunk's rows are added up before they leave it

# Byte classes.  White space is 0x20 and 0x09-0x0D; letters and digits are
# 0-9, a-z (after lower-casing) and every byte of a non-ASCII code point.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[0x30:0x3A] = LETTER_OR_DIGIT[0x61:0x7B] = LETTER_OR_DIGIT[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its front and of its last word."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


BASE = 0xA24BAED4963EE407  # odd, so it has an inverse modulo 2**64
BYTE_VALUE = mix(np.arange(256, dtype=np.uint64))
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n (kept for the next call)."""
    if len(_power["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _power[name] = np.multiply.accumulate(step)
    return _power["up"], _power["down"]


class Chunk(NamedTuple):
    """Some rows of a batch: their bytes end to end and the place of each row."""

    first: int              # index of the first row in the batch
    data: np.ndarray        # uint8
    offsets: np.ndarray     # int64, rows + 1, from 0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """Words of a chunk: byte range and hash of each, and each row's word range."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray     # int64, rows + 1: words of row i are offsets[i]:offsets[i + 1]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty) into chunks of about ``limit`` bytes."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[
        texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + 20_000)
        yield Chunk(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def words(chunk: Chunk, kind: np.ndarray = NOT_SPACE, lower: bool = True,
          want_hash: bool = True) -> Words:
    """Maximal runs of bytes of class ``kind`` (after lower-casing A-Z), never across rows."""
    data = LOWER[chunk.data] if lower else chunk.data
    inside = kind[data]
    n = len(data)
    filled = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[filled] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[chunk.offsets[1:][np.diff(chunk.offsets) > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    hashed = hash_ranges(data, start, end) if want_hash else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, chunk.offsets).astype(np.int64))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal bytes wherever they lie."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def ngrams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside a row, and each row's range of them.

    With ``short``, a row of fewer words (but not none) has its whole sequence as one.
    """
    count = np.diff(w.offsets)
    made = np.maximum(count - n + 1, 0)
    few = (count > 0) & (count < n) if short else np.zeros(len(count), bool)
    made = np.where(few, 1, made)
    offsets = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(w.offsets[:-1], made)
    full = np.repeat(~few, made)
    out = np.zeros(offsets[-1], np.uint64)
    at = first[full]
    h = w.hash[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, n):
        h = join_hash(h, w.hash[at + k])
    out[full] = h
    for size in range(1, n):
        rows = np.flatnonzero(few & (count == size))
        if len(rows):
            h = w.hash[w.offsets[rows]]
            for k in range(1, size):
                h = join_hash(h, w.hash[w.offsets[rows] + k])
            out[offsets[rows]] = mix(h + np.uint64(size))
    return out, offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with their new ranges."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bits = np.uint64(max(1, (len(offsets) - 1).bit_length()))
    # by row and the values' upper bits in one sort; by both if that leaves different values in one place
    key = row.astype(np.uint64) << (np.uint64(64) - bits) | values >> bits
    order = np.argsort(key)
    ordered, key = values[order], key[order]
    if ((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])).any():
        order = np.lexsort((values, row))
        ordered = values[order]
    values, row = ordered, row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(offsets))).astype(np.int64)
