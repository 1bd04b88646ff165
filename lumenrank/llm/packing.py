"""Best-fit packing by minimum bin slack.

The number of sequences a packing needs depends only on how many pieces there are
of each length, and lengths are at most ``capacity``.  So Spark tokenizes and counts
pieces by length; the counts (one row a length, whatever the input's size) go to the
search for fullest combinations, and Spark then hands every piece its place:

1. ``cut_documents``: text -> token ids + end id -> pieces of at most ``capacity``.
2. ``fullest_combinations``: the longest length left opens a bin; a subset-sum over
   the other lengths, with sums as bits of one integer, finds the fullest bin; that
   combination is removed as often as the counts allow.  Each step uses up a length,
   so there are at most ``capacity`` combinations.
3. ``place``: pieces of a length are numbered (per salt and length, then the salts'
   counts are added up) and the number says which combination, copy and slot it gets.

Defined results: null text is empty and gives one piece, the end id alone.  Rows that
repeat are packed once each.  An empty table gives no rows.  Ties between pieces of
one length go by salt, document id, then piece.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import chunks
from .tables import documents, keep, read

CAPACITY = 2048
END_ID = 0
SALTS = 64
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 300_000

# What may be encoded by itself.  The vocabulary's rule cuts between letters and other
# characters, so an ASCII or Latin-1 letter run and an ASCII sign run are whole units if
# no other character touches them; anything else is taken up to the next white space.
_UNIT = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff'])"
                   rb"|[!-&(-@\[-`{-~]++(?![\x80-\xff'])|[^\x09-\x0d\x20]+")
# Combining marks (may join the letter before) and special tokens: encoded as a whole.
_WHOLE = re.compile(rb"[\xcc\xcd]|<\|")


class Encoder:
    """Token ids of texts as little-endian bytes, remembering units it has met.

    The units of a chunk of texts that are not known yet are learned together.  With
    ``CACHED_WORDS`` units everything is forgotten, so that many and one chunk's bound the
    memory; frequent units are back after a chunk or two.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in coded]

    def _learn(self, units: list[bytes]) -> None:
        plain = [u for u in units if u.isalpha() or b"\xc3" in u and _UNIT.fullmatch(u) and b"'" not in u]
        parts = [plain[i:i + 512] for i in range(0, len(plain), 512)]
        for part, ids in zip(parts, self._ids([b" ".join(x) for x in parts])):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()    # letter runs end in exactly one word-end token
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.known.update(zip(part, (data[4 * i:4 * j] for i, j in zip([0, *cuts], cuts))))
        rest = [u for u in units if u not in self.known]
        self.known.update(zip(rest, (x.tobytes() for x in self._ids(rest))))

    def __call__(self, text: bytes) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text of a chunk."""
        units = [None if _WHOLE.search(x) else _UNIT.findall(x.lower()) for x in texts]
        self._learn(list(set(chain.from_iterable(u for u in units if u is not None)).difference(self.known)))
        whole = iter(self._ids([x for x, u in zip(texts, units) if u is None]))
        out = [next(whole).tobytes() if u is None else b"".join(map(self.known.__getitem__, u)) for u in units]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                  with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for c in chunks(batch.column("text")):
                ids = [x + end for x in encode.all([c.text(i) for i in range(c.rows)])]
                rows = [(i, p, s) for i, x in enumerate(ids)
                        for p, s in enumerate(range(0, len(x), 4 * capacity))]
                parts = [ids[i][s:s + 4 * capacity] for i, _, s in rows]
                columns = [
                    batch.column("doc_id").take(pa.array([c.first + i for i, _, _ in rows], pa.int64())),
                    pa.array([p for _, p, _ in rows], pa.int32()),
                    pa.array([s // 4 for _, _, s in rows], pa.int64()),
                    pa.array([len(x) // 4 for x in parts], pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents(docs).mapInArrow(cut, schema)


def fullest_combination(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that holds the longest length left."""
    first = max(counts)
    room = capacity - first
    items = []  # (length, copies taken at once): 1, 2, 4 ... copies of each length
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        step = 1
        while left > 0:
            items.append((length, min(step, left)))
            left -= step
            step *= 2
    sums, seen = 1, []
    limit = (1 << (room + 1)) - 1
    for length, copies in items:
        seen.append(sums)
        sums |= (sums << (length * copies)) & limit
        if sums >> room & 1:
            break
    total, taken = sums.bit_length() - 1, [first]
    for (length, copies), before in zip(reversed(items[:len(seen)]), reversed(seen)):
        if not before >> total & 1:
            taken += [length] * copies
            total -= length * copies
    return taken


def fullest_combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations with the number of bins that use each, until no piece is left."""
    counts, out = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        lengths = fullest_combination(counts, capacity)
        uses = {x: lengths.count(x) for x in set(lengths)}
        times = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((lengths, times))
    return out


def slots(combinations: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranges of piece numbers with their first sequence and offset."""
    rows, used, sequence = [], dict.fromkeys(range(capacity + 1), 0), 0
    for lengths, times in combinations:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"bounds": np.searchsorted(table[:, 0], np.arange(capacity + 2)), "from": table[:, 1],
            "sequence": table[:, 2], "offset": table[:, 3]}


def place(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...); ``pieces`` is read three times."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # at most capacity * salts rows, a bound that the input's size does not change
    table = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in per_salt.collect():
        table[length, salt] = n
    counts = {int(k): int(v) for k, v in enumerate(table.sum(axis=1)) if v}
    before = spark.sparkContext.broadcast(np.cumsum(table, axis=1) - table)
    places = spark.sparkContext.broadcast(slots(fullest_combinations(counts, capacity), capacity))
    given = pieces.columns
    numbered = salted.withColumn("_number", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")) - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, base = places.value, before.value
        for batch in batches:
            if not len(batch):
                continue
            length, salt, number = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
                                    for x in ("length", "_salt", "_number"))
            number = number + base[length, salt]
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for x in np.unique(length):
                rows, lo, hi = length == x, p["bounds"][x], p["bounds"][x + 1]
                at = lo + np.searchsorted(p["from"][lo:hi], number[rows], "right") - 1
                sequence[rows] = p["sequence"][at] + number[rows] - p["from"][at]
                offset[rows] = p["offset"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in given] + [pa.array(sequence), pa.array(offset)],
                names=[*given, "sequence_id", "offset"])

    return numbered.mapInArrow(assign, ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    pieces = keep(cut_documents(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 2048 tokens, few and full."""
    return pack(read(spark, sf_dir, "documents"))
