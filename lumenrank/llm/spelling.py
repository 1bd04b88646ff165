"""Spelling variants: words one edit apart, found with a bidirectional FM-index.

1. ``vocabulary`` counts the words of all texts (distinct words of a chunk of text are
   added up in the task, then by Spark).
2. A word one edit away from a query has the query's first half at its front or its
   second half at its end.  So each word goes, as a query, to the blocks of its two
   halves, and, as an entry, to the blocks of the fronts and ends of the lengths that a
   query's half can have (at most four).  Blocks are hashes of halves; a block with more
   than ``BLOCK`` characters is dealt into parts of entries and slices of queries, every
   slice meeting every part, so no task depends on how often a half occurs.
3. In a block, :class:`Index` is a bidirectional FM-index of its entries, each after a
   delimiter.  :func:`one_edit` matches a half exactly, outward to its delimiter, then
   extends the suffix-rank interval across the other half and allows one error: at every
   place the symbols that the interval really has are tried as a replacement or an
   insertion, or the query's symbol is left out, and the rest must match exactly.
4. ``variants`` adds the counts up per word, takes the commonest near word and follows
   forms to the last by doubling (a form is at least twice as common, so few rounds do).

Defined results: null text has no words; a null id counts as an empty one in the hash
that decides on deletions; rows that repeat count each; an empty table gives no rows.
Other columns are ignored.  Ties between near words go to the smaller one by code points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, Chunk, chunks, words
from .tables import documents, keep, read, sent_if_small

LEAST_LENGTH = 5
LEAST_COUNT = 3
FORM_FACTOR = 2
DELETE_EVERY = 97
BLOCK = 1 << 20         # characters of entries (or queries) that one task indexes (or looks up)
BATCH = 8192            # queries that are looked up at once
CHUNK = 1 << 20

LEAD = 0xC3             # first UTF-8 byte of U+00C0 to U+00FF, and of no other code point
_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = _WORD[0x80:] = True


# ---------------------------------------------------------------- vocabulary

def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reversed polynomial 0xEDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, continuing from the checksum of what stands before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size, state = start[order], size[order], ~before[order].astype(np.uint32)
    for j in range(min(int(size[0]) if len(size) else 0, 64)):
        n = int(np.searchsorted(-size, -j, "left"))     # ranges of more than j bytes
        x = state[:n]
        state[:n] = _CRC[(x ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for i in order[:int(np.searchsorted(-size, -64, "left"))]:
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(before[i]))
    return out


def _chunk_words(chunk: Chunk, ids: list) -> pa.Array:
    """The words of a chunk, one entry per occurrence, shorter ones left out."""
    data = LOWER[chunk.data]
    follows = np.zeros(len(data), bool)
    follows[1:] = data[:-1] == LEAD
    data = np.where((data >= 0x80) & (data != LEAD) & ~follows, np.uint8(0x20), data)
    w = words(Chunk(chunk.first, data, chunk.offsets), _WORD, lower=False, want_hash=False)
    if not len(w.start):
        return pa.array([], pa.string())
    two = np.concatenate([[0], np.cumsum(data == LEAD)])
    points = (w.end - w.start) - (two[w.end] - two[w.start])
    named = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _crc32(data, w.start, w.end, named[w.row])
    changed = crc % DELETE_EVERY == 0
    plain = ~changed & (points >= LEAST_LENGTH)
    start, size = w.start[plain], (w.end - w.start)[plain]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)),
                                        pa.py_buffer(data[place]))
    edited = []
    for i in np.flatnonzero(changed & (points > LEAST_LENGTH)):
        x = data[w.start[i]:w.end[i]].tobytes().decode()
        at = int(crc[i]) % len(x)
        edited.append(x[:at] + x[at + 1:])
    return pa.concat_arrays([texts, pa.array(edited, pa.string())])


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of all texts, after the deletions, that occur often enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for c in chunks(batch.column("text"), CHUNK):
                counted = pc.value_counts(_chunk_words(c, ids[c.first:c.first + c.rows]))
                yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "n"])

    return (documents(docs).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# ---------------------------------------------------------------- index

SYMBOLS = 1 + 26 + 64       # delimiter, a to z, U+00C0 to U+00FF
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0xC0:] = np.arange(27, SYMBOLS)
_STRIDE = 64


def _sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Starts of all rotations of a cyclic text in order; no two rotations are equal."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    for k in range(9):                                  # nine symbols of seven bits
        rank = rank << 7 | np.roll(text, -k).astype(np.int64)
    done = 9
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.concatenate([[0], np.cumsum(rank[order][1:] != rank[order][:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        rank = rank * n + np.roll(rank, -(done % n))
        done *= 2


class Half(NamedTuple):
    """One direction of the index: the symbol before each sorted rotation, with counts."""

    last: np.ndarray        # uint8, padded to whole strides: the symbol before each rotation
    below: np.ndarray       # [i, c]: symbols below c before stride i
    first: np.ndarray       # [c]: rotations that start with a symbol below c

    @classmethod
    def of(cls, text: np.ndarray, order: np.ndarray) -> Half:
        n = len(text)
        strides = n // _STRIDE + 1
        last = np.full(strides * _STRIDE, SYMBOLS, np.uint8)
        last[:n] = text[order - 1]
        each = np.bincount(np.arange(len(last)) // _STRIDE * (SYMBOLS + 1) + last,
                           minlength=strides * (SYMBOLS + 1)).reshape(strides, SYMBOLS + 1)[:, :SYMBOLS]
        before = np.cumsum(each, axis=0) - each
        below = np.zeros((strides, SYMBOLS + 1), np.int32)
        np.cumsum(before, axis=1, out=below[:, 1:])
        total = np.bincount(text, minlength=SYMBOLS)
        return cls(last.reshape(strides, _STRIDE), below, np.concatenate([[0], np.cumsum(total)]))

    def count(self, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``place`` last symbols are below, and equal to, ``symbol``."""
        stride, rest = place // _STRIDE, place % _STRIDE
        inside = np.arange(_STRIDE) < rest[:, None]
        part, c = self.last[stride], symbol[:, None]
        lower = self.below[stride, symbol]
        return (lower + ((part < c) & inside).sum(axis=1),
                self.below[stride, symbol.astype(np.int64) + 1] - lower + ((part == c) & inside).sum(axis=1))

    def spread(self, place: np.ndarray) -> np.ndarray:
        """[i, c]: symbols equal to c among the first ``place[i]`` last symbols."""
        stride, rest = place // _STRIDE, place % _STRIDE
        part = np.where(np.arange(_STRIDE) < rest[:, None], self.last[stride], np.uint8(SYMBOLS))
        inside = np.bincount((np.arange(len(place))[:, None] * (SYMBOLS + 1) + part).ravel(),
                             minlength=len(place) * (SYMBOLS + 1)).reshape(len(place), SYMBOLS + 1)
        return np.diff(self.below[stride], axis=1) + inside[:, :SYMBOLS]


class Index(NamedTuple):
    """A bidirectional FM-index of distinct words, each after a delimiter, in a circle."""

    left: Half              # extends a match by the symbol before it
    right: Half             # extends a match by the symbol behind it (left, of the reversed text)
    entry: np.ndarray       # word that starts at each sorted rotation with a delimiter in front

    @classmethod
    def of(cls, entries: list[bytes]) -> Index:
        text = _SYMBOL[np.frombuffer(b"\n" + b"\n".join(entries), np.uint8)]
        order = _sorted_rotations(text)
        back = text[::-1].copy()
        starts = np.cumsum(text == 0) - 1
        return cls(Half.of(text, order), Half.of(back, _sorted_rotations(back)),
                   starts[order[:len(entries)]])

    def flipped(self) -> Index:
        """The same index read from right to left."""
        return Index(self.right, self.left, self.entry)


class Matches(NamedTuple):
    """Intervals of rotations, for queries: where the match starts, and where its mirror image does."""

    query: np.ndarray
    at: np.ndarray          # next place of the query to match
    low: np.ndarray
    mirror: np.ndarray
    size: np.ndarray

    def where(self, rows: np.ndarray) -> Matches:
        return Matches(*(x[rows] for x in self))


def _extend_left(index: Index, m: Matches, symbol: np.ndarray) -> Matches:
    """Matches with ``symbol`` in front, those that exist."""
    lower, equal = index.left.count(m.low, symbol)
    lower_end, equal_end = index.left.count(m.low + m.size, symbol)
    out = Matches(m.query, m.at, index.left.first[symbol] + equal, m.mirror + lower_end - lower, equal_end - equal)
    return out.where(out.size > 0)


def _swap(m: Matches) -> Matches:
    return m._replace(low=m.mirror, mirror=m.low)


def _extend_right(index: Index, m: Matches, symbol: np.ndarray) -> Matches:
    return _swap(_extend_left(index.flipped(), _swap(m), symbol))


def _branches(index: Index, m: Matches) -> tuple[np.ndarray, np.ndarray, Matches]:
    """Every right extension by a letter: row of ``m``, symbol and match."""
    half = index.right
    low, high = half.spread(m.mirror), half.spread(m.mirror + m.size)
    sizes = high - low
    before = np.cumsum(sizes, axis=1) - sizes
    row, symbol = np.nonzero(sizes[:, 1:])
    symbol += 1
    return row, symbol, Matches(m.query[row], m.at[row], m.low[row] + before[row, symbol],
                                half.first[symbol] + low[row, symbol], sizes[row, symbol])


def one_edit(index: Index, symbols: np.ndarray, offsets: np.ndarray, half: np.ndarray) -> Matches:
    """Entries that start with a query's first ``half`` symbols and are one edit from it.

    ``symbols[offsets[i]:offsets[i + 1]]`` is query i.  Returns a row per alignment found
    (an entry may come by several), as matches of the whole entry with both delimiters.
    """
    n = len(half)
    size = np.diff(offsets)
    zero = np.zeros(n, np.int64)
    m = Matches(np.arange(n), half.astype(np.int64), zero, zero, np.full(n, index.left.first[-1]))
    for step in range(int(half.max(initial=0)) + 1):     # from the middle outward to the delimiter
        open_ = half[m.query] - step >= 0
        done, m = m.where(~open_), m.where(open_)
        place = half[m.query] - step - 1
        symbol = np.where(place >= 0, symbols[offsets[:-1][m.query] + np.maximum(place, 0)], 0)
        m = Matches(*map(np.concatenate, zip(done, _extend_left(index, m, symbol))))

    def next_symbol(m: Matches) -> np.ndarray:
        inside = m.at < size[m.query]
        return np.where(inside, symbols[np.minimum(offsets[:-1][m.query] + m.at, len(symbols) - 1)], 0)

    wrong: list[Matches] = []
    while len(m.query):
        row, symbol, tried = _branches(index, m)
        wrong.append(tried)                                             # a symbol too many
        inside = m.at < size[m.query]
        other = inside[row] & (symbol != next_symbol(m)[row])
        wrong.append(tried.where(other)._replace(at=tried.at[other] + 1))     # another symbol
        m = m.where(inside)
        wrong.append(m._replace(at=m.at + 1))                           # a symbol left out
        m = _extend_right(index, m, next_symbol(m))
        m = m._replace(at=m.at + 1)
    m = Matches(*map(np.concatenate, zip(*wrong))) if wrong else m
    found = [m.where(zero[:0])]
    while len(m.query):
        m = _extend_right(index, m, next_symbol(m))
        ends = m.at == size[m.query]                                    # that was the delimiter
        found.append(m.where(ends))
        m = m.where(~ends)
        m = m._replace(at=m.at + 1)
    return Matches(*map(np.concatenate, zip(*found)))


def near_in_block(entries: list[str], counts: np.ndarray, queries: list[str],
                  ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(query, near entries, commonest near entry, its count) of queries by their first half, or by the second where ``ends``.

    A near entry that has both halves counts with the first.
    """
    index = Index.of([x.encode("latin-1") for x in entries])
    for side in (False, True):
        mine = np.flatnonzero(ends == side)
        for i in range(0, len(mine), BATCH):
            batch = mine[i:i + BATCH]
            texts = [queries[k].encode("latin-1") for k in batch]
            sizes = np.array([len(x) for x in texts])
            read = [x[::-1] for x in texts] if side else texts
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            half = sizes - sizes // 2 if side else sizes // 2
            m = one_edit(index.flipped() if side else index, _SYMBOL[np.frombuffer(b"".join(read), np.uint8)],
                            offsets, half)
            entry = index.entry[m.mirror if side else m.low]
            pairs = np.unique(m.query * len(entries) + entry)
            query, entry = pairs // len(entries), pairs % len(entries)
            if side:
                first = np.array([not entries[e].startswith(queries[batch[q]][:sizes[q] // 2])
                                  for q, e in zip(query.tolist(), entry.tolist())], bool)
                query, entry = query[first], entry[first]
            n = counts[entry]
            best = np.lexsort((entry, -n, query))       # entries are in code-point order
            query, entry, n = query[best], entry[best], n[best]
            at = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
            for a, b in zip(at, [*at[1:], len(query)]):
                yield int(batch[query[a]]), int(b - a), int(entry[a]), int(n[a])


# ---------------------------------------------------------------- blocks

def _keys(lengths: list[Column], end: bool) -> list[Column]:
    word = F.col("word")
    return [F.struct(F.lit(end).alias("end"), F.col("word"), (word.substr(F.length(word) - x + 1, x) if end
                                                              else word.substr(F.lit(1), x)).alias("key")) for x in lengths]


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best (n, word): near words of every word of ``vocab`` (word, n), where it has any."""
    size = F.length("word")
    half = lambda x: F.floor(x / 2).cast("int")
    total = vocab.agg(F.sum(size + 1).alias("n")).first()["n"] or 0
    buckets = max(1, 8 * total // block)
    entries = F.array(*_keys([half(size - 1), half(size + 1)], False), *_keys([half(size), half(size + 2)], True))
    asked = F.array(*_keys([half(size)], False), *_keys([size - half(size)], True))

    def rows(keys: Column, query: bool) -> DataFrame:
        return (vocab.select("word", "n", F.explode(keys).alias("k"))
                .select(F.pmod(F.xxhash64("k.end", "k.key"), F.lit(buckets)).alias("bucket"),
                        F.lit(query).alias("query"), F.col("k.end").alias("end"), "word", "n"))

    # a word that comes to one bucket by several keys is one entry there
    entry = rows(entries, False).groupBy("bucket", "query", "word", "n").agg(F.min("end").alias("end"))
    both = entry.unionByName(rows(asked, True))
    chars = F.length("word") + 1
    crowded = keep(both.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(~F.col("query"), chars)) / block).alias("parts"),
        F.ceil(F.sum(F.when(F.col("query"), chars)) / block).alias("slices"))
        .where("parts > 1 or slices > 1"), "crowded-blocks")
    dealt = (both.join(sent_if_small(crowded), "bucket", "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("slices", F.coalesce("slices", F.lit(1))))
    own = F.xxhash64("word")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = (dealt.withColumn("part", F.explode(F.when(F.col("query"), every("parts"))
                                                .otherwise(F.array(F.pmod(own, F.col("parts"))))))
             .withColumn("slice", F.explode(F.when(F.col("query"), F.array(F.pmod(own, F.col("slices"))))
                                            .otherwise(every("slices")))))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy(zero_copy_only=False)
        listed = table.filter(pa.array(~asks)).sort_by("word")
        queries = table.filter(pa.array(asks))
        texts, named = listed.column("word").to_pylist(), queries.column("word").to_pylist()
        found = []
        if texts and named:
            ends = queries.column("end").to_numpy(zero_copy_only=False)
            found = [(named[q], n, best_n, texts[e]) for q, n, e, best_n in
                     near_in_block(texts, listed.column("n").to_numpy(), named, ends)]
        columns = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                        names=["word", "n_near", "best_n", "best"])

    found = (dealt.select("bucket", "part", "slice", "query", "end", "word", "n")
             .groupBy("bucket", "part", "slice")
             .applyInArrow(search, "word string, n_near long, best_n long, best string"))
    return (found.groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
            .select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form)."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = keep(up.join(above, F.col("root") == F.col("_word"), "left")
                    .select("word", F.coalesce("_root", "root").alias("root"),
                            F.col("_root").isNotNull().alias("_moved")), "roots")
        up = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return up


def variants(docs: DataFrame, least: int = LEAST_COUNT, factor: int = FORM_FACTOR, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    vocab = keep(vocabulary(docs, least), "vocabulary")
    near = near_words(vocab, block)
    common = F.col("best_n") >= factor * F.col("n")
    words_ = keep(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")), "near-words")
    roots = _roots(words_.where("form is not null").select("word", "form"))
    return words_.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants(read(spark, sf_dir, "documents"))
