"""Benchmark decontamination: documents that hold windows of benchmark items.

A prefix-filtered set join for full containment.  The corpus counts of the items'
words give the rarity order; the one necessary prefix token of a window is its rarest
word, so only document words that are some window's rarest are candidates.  A
candidate's place in the window fixes where the window must start (positional bound)
and that it must end inside the document (length bound); then the words are compared
one after another over the whole window, and only survivors go on to the next word.

Documents stay where they are: the windows of a block of items go to every task.  A
block holds at most ``BLOCK_WORDS`` item words, which bounds what is sent; a larger
benchmark makes more blocks, each another pass, whose hits are united per document.

Defined results: null and word-less texts have no words, no hits, and are clean; items
without words match nothing; equal items (also equal ids) all count, each id once; a
null item id is reported as the text "null"; no items: every document is clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LETTER_OR_DIGIT, Chunk, chunks, words
from .tables import documents, keep, pick, read

WINDOW = 13
BLOCK_WORDS = 1_000_000


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Ids and word hashes of the items, in blocks of at most ``block_words`` (one item at least)."""
    ids, hashes, size = [], [], 0
    rows = pick(items, item_id="string", text="string").fillna({"item_id": "null", "text": ""})
    for item_id, text in rows.toLocalIterator():  # a partition at a time
        data = np.frombuffer(text.encode(), np.uint8)
        h = words(Chunk(0, data, np.array([0, len(data)])), LETTER_OR_DIGIT).hash
        if ids and size + len(h) > block_words:
            yield ids, hashes
            ids, hashes, size = [], [], 0
        ids.append(item_id)
        hashes.append(h)
        size += len(h)
    if ids:
        yield ids, hashes


class Windows:
    """Distinct windows of a block of items, grouped by their rarest word."""

    def __init__(self, ids: list[str], hashes: list[np.ndarray], count: dict[int, int], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, h in zip(ids, hashes):
            for i in range(max(len(h) - window, 0) + 1 if len(h) else 0):
                owners.setdefault(h[i:i + window].tobytes(), set()).add(item)
        keys = list(owners)
        self.items = [sorted(owners[k]) for k in keys]
        self.words = np.zeros((len(keys), window), np.uint64)
        self.length = np.array([len(k) // 8 for k in keys], np.int64)
        anchor, place = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        for i, k in enumerate(keys):
            h = np.frombuffer(k, np.uint64)
            self.words[i, :len(h)] = h
            place[i] = min(range(len(h)), key=lambda j: (count.get(int(h[j]), 0), int(h[j]), j))
            anchor[i] = h[place[i]]
        order = np.argsort(anchor, kind="stable")
        self.order, self.place = order, place[order]
        self.anchors, first = np.unique(anchor[order], return_index=True)
        self.bounds = np.append(first, len(order)).astype(np.int64)

    def find(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (index into ``hashes``) and number of every window that occurs inside a row."""
        if not len(self.anchors) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.anchors, hashes), len(self.anchors) - 1)
        hit = np.flatnonzero(self.anchors[at] == hashes)
        row = np.searchsorted(offsets, hit, "right") - 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        many = np.diff(self.bounds)[at[hit]]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(hit):  # at most a million candidates at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
            n = many[lo:hi]
            sorted_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[at[hit[lo:hi]]], n)
            window = self.order[sorted_at]
            start = np.repeat(hit[lo:hi], n) - self.place[sorted_at]
            r = np.repeat(row[lo:hi], n)
            ok = (start >= offsets[r]) & (start + self.length[window] <= offsets[r + 1])
            start, window = start[ok], window[ok]
            for k in range(self.words.shape[1]):
                longer = self.length[window] > k
                same = hashes[np.minimum(start + k, len(hashes) - 1)] == self.words[window, k]
                start, window = start[~longer | same], window[~longer | same]
            found.append((start, window))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def word_counts(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each wanted word hash occurs in all documents (``wanted`` is of a block's size)."""
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for c in chunks(batch.column("text")):
                h = words(c, LETTER_OR_DIGIT).hash
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                met, n = np.unique(at[keys[at] == h], return_counts=True)
                total[met] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    if not len(sent.value):
        return {}
    rows = documents(docs).select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {h % (1 << 64): n for h, n in rows.collect()}


def find_hits(docs: DataFrame, windows: Windows) -> DataFrame:
    """doc_id, n_words, hit ranges of words (``from``, ``to``: arrays) and item ids, a row per document."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                got = words(c, LETTER_OR_DIGIT)
                start, window = w.find(got.hash, got.offsets)
                n = c.rows
                out_from, out_to, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
                if len(start):
                    order = np.argsort(start, kind="stable")
                    start, window = start[order], window[order]
                    row = np.searchsorted(got.offsets, start, "right") - 1
                    for r, s, x in zip(row.tolist(), (start - got.offsets[row]).tolist(), window.tolist()):
                        e = s + int(w.length[x])
                        if out_to[r] and s <= out_to[r][-1]:
                            out_to[r][-1] = max(e, out_to[r][-1])
                        else:
                            out_from[r].append(s)
                            out_to[r].append(e)
                        items[r].update(w.items[x])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(x).slice(c.first, n) for x in carried),
                    pa.array(np.diff(got.offsets)),
                    pa.array(out_from, pa.list_(pa.int64())), pa.array(out_to, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*carried, "n_words", "hit_from", "hit_to", "items"])

    carried = [x for x in docs.columns if x != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(find, f"{schema}, n_words long, hit_from array<long>, hit_to array<long>, items array<string>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the blocks' ranges and items of each document into the counts of the result."""
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for starts, ends, items in zip(*(batch.column(x).to_pylist() for x in ("hit_from", "hit_to", "items"))):
            hit, reach = 0, 0
            for s, e in sorted(zip(starts, ends)):
                hit += max(0, e - max(s, reach))
                reach = max(reach, e)
            ids = sorted(set(items))
            n_hit.append(hit)
            n_items.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()),
                                          pa.array(n_items, pa.int64()), pa.array(sha, pa.string())],
                                         names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, per_mille: int = 50,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, items found, and whether 5 % or more is hit."""
    docs, parts = documents(docs), []
    for ids, hashes in item_blocks(items, block_words):
        count = word_counts(docs, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
        parts.append(Windows(ids, hashes, count, window))
    if len(parts) <= 1:
        hits = find_hits(docs, parts[0] if parts else Windows([], [], {}, window))
    else:
        # rows of equal id must stay apart, so each row gets a number that all passes share
        numbered = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits = None
        for w in parts:
            found = find_hits(numbered, w)
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy("_row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("hit_from")).alias("hit_from"), F.flatten(F.collect_list("hit_to")).alias("hit_to"),
            F.flatten(F.collect_list("items")).alias("items")).drop("_row")
    out = hits.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (1000 * F.col("n_hit") >= per_mille * F.col("n_words")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
