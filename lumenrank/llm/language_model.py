"""Interpolated modified Kneser-Ney model, order 2, over words.

Counting: every task gathers word pairs (the word before, or the text's begin, and the
word, or the text's end) and sends them summed, as blocks of arrays, to the shard of the
first word's hash.  A shard's task adds the blocks up and writes sorted hash arrays:
pairs with counts, and contexts with their counts of counts.  It sends on, per second
word, in how many contexts it occurs and how often; those go to the shard of that word's
hash and become the array of words.  The number of shards grows with the corpus, so that
a shard's task stays at a fixed size; discounts come from sums over the shards.

Scoring: a worker maps the shards' files into memory and looks hashes up by binary
search; only the pages it touches are read, and workers of a machine share them.  The
files are in the folder of ``spark.checkpoint.dir``, which must be mounted on executors
(``file:``); a file is written under another name first, so a repeated task does no harm.

P(w) = max(c(w) - D, 0) / C + g / (V + 1), with c(w) the number of contexts of w;
P(w | v) = max(n(v, w) - D', 0) / n(v) + g(v) P(w); an unseen v leaves P(w).

Defined results: null text is empty, whose one token is the end; repeated rows count and
are scored each; a null id counts as empty text for the fold; without training text every
token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WIDE, Words, chunks, join_hash, mix, words
from .tables import documents, fold, keep, read, shared_folder

BEGIN, END = (mix(np.array([x], np.uint64))[0] for x in (0xB16B00B5, 0xE2D))
BLOCK_TOKENS = 3_000_000
SHARD_BYTES = 16 << 20      # of training text for each shard
MOST_SHARD_BITS = 20      # a million shards; with more than 16 TB of training text they grow
_HIGH = np.uint64(0xFFFFF << 44)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a pair; its 20 high bits are those of the first word, so both share a shard."""
    return (before & _HIGH) | (join_hash(before, word) >> np.uint64(20))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's words and an end, the token before each, and each row's range."""
    n = np.diff(w.offsets) + 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.full(offsets[-1], END)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = w.hash
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[offsets[:-1]] = BEGIN
    return out, before, offsets


def _sum_by(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Index of one row per key in key order, and sums of the counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return order[first], *(np.add.reduceat(c[order], first) if len(key) else c for c in counts)


def _shards(key: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard begins in sorted keys."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])


def _blocks(key: np.ndarray, bits: int, sizes: np.ndarray | None, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row per shard that has keys; arrays go along, those of words by ``sizes`` per key."""
    at = _shards(key, bits)
    into = at if sizes is None else np.concatenate([[0], np.cumsum(sizes)])[at]
    some = np.flatnonzero(np.diff(at))
    cut = lambda x, by: pa.array([x[by[s]:by[s + 1]].tobytes() for s in some], pa.binary())
    columns = {"shard": pa.array(some.astype(np.int32)), "key": cut(key, at)}
    if sizes is not None:
        columns["sizes"] = cut(sizes.astype(np.uint32), at)
    columns |= {name: cut(x, into) for name, x in arrays.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def count_pairs(docs: DataFrame, bits: int) -> DataFrame:
    """Blocks of pairs by first word: shard, key (first words), sizes, word, n."""
    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        before, word = (np.concatenate(x) for x in zip(*held))
        rows, n = _sum_by(pair_key(before, word), np.ones(len(word), np.uint32))
        before, word = before[rows], word[rows]
        order = np.argsort(before, kind="stable")
        before, word, n = before[order], word[order], n[order]
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        return _blocks(before[first], bits, np.diff(np.append(first, len(before))), word=word, n=n.astype(np.uint32))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for c in chunks(batch.column("text"), WIDE):
                word, before, _ = tokens(words(c))
                held.append((before, word))
                size += len(word)
                if size >= BLOCK_TOKENS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return docs.select("text").mapInArrow(gather, "shard int, key binary, sizes binary, word binary, n binary")


def _by_shard(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[tuple[int, list[dict]]]:
    rows = ((b.column("shard")[i].as_py(), {k: np.frombuffer(b.column(k)[i].as_py(), t) for k, t in kinds.items()})
            for b in batches for i in range(len(b)))
    for shard, group in groupby(rows, key=lambda r: r[0]):
        yield shard, [r[1] for r in group]


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files that appear whole or not at all."""
    for part, x in arrays.items():
        draft = f"{folder}/.{name}-{part}-{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            np.save(f, x)
        os.replace(draft, f"{folder}/{name}-{part}.npy")


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in range(1, 5)]


def merge_pairs(blocks: DataFrame, folder: str, bits: int) -> DataFrame:
    """Write each shard's pairs and contexts; blocks of second words (shard, key, contexts, n) go on.

    A shard's row of counts of counts has shard -1 (``stats``: pairs with 1, 2, 3, 4, tokens, and the shard).
    """
    names = ["shard", "key", "contexts", "n", "stats"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches, {"key": np.uint64, "sizes": np.uint32, "word": np.uint64, "n": np.uint32}):
            before = np.concatenate([np.repeat(p["key"], p["sizes"]) for p in parts])
            word, n = (np.concatenate([p[k] for p in parts]) for k in ("word", "n"))
            parts.clear()
            key = pair_key(before, word)
            rows, n = _sum_by(key, n.astype(np.int64))
            key, before, word = key[rows], before[rows], word[rows]
            _write(folder, f"pairs-{shard}", key=key, n=n.astype(np.uint32 if n.max(initial=0) >> 32 == 0 else np.uint64))
            ones = [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]
            rows, total, *kinds = _sum_by(before, n, *ones)
            _write(folder, f"contexts-{shard}", key=before[rows], total=total, kinds=np.stack(kinds, axis=1).astype(np.uint32))
            stats = [*_counts_of_counts(n), int(n.sum()), shard]
            rows, contexts, total = _sum_by(word, np.ones(len(word), np.int64), n)
            out = _blocks(word[rows], bits, None, contexts=contexts.astype(np.uint32), n=total)
            empty = pa.array([b""] * len(out), pa.binary())
            yield pa.RecordBatch.from_arrays([*out.columns, empty], names=names)
            empty = empty[:1]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), empty, empty, empty, pa.array(
                [np.array(stats, np.int64).tobytes()], pa.binary())], names=names)

    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        merge, "shard int, key binary, contexts binary, n binary, stats binary")


def merge_words(blocks: DataFrame, folder: str) -> DataFrame:
    """Write each shard's words; rows of statistics, of pairs (0) and of words (1)."""
    names = ["words", "stats"]

    def row(kind: int, stats: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([stats], pa.list_(pa.int64()))], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches, {"key": np.uint64, "contexts": np.uint32, "n": np.int64, "stats": np.int64}):
            if shard < 0:
                for p in parts:
                    yield row(0, p["stats"].tolist())
                continue
            key = np.concatenate([p["key"] for p in parts])
            rows, contexts, n = _sum_by(key, *(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in ("contexts", "n")))
            _write(folder, f"words-{shard}", key=key[rows], contexts=contexts, n=n)
            stats = [*_counts_of_counts(contexts), int((contexts > 2).sum()), int(contexts.sum()), len(rows), shard]
            yield row(1, stats)

    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "words int, stats array<long>")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What to take off counts of 0, 1, 2, and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [0.0, *(k - (k + 1) * y * up / n if n else k / 2 for k, n, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    return np.clip(raw, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class Model(NamedTuple):
    folder: str
    bits: int
    tokens: int             # N
    words: int              # V
    pair_discount: np.ndarray
    word_discount: np.ndarray
    all_contexts: int       # C
    rest: float             # g
    pair_shards: np.ndarray  # whether a shard of pairs and contexts was written, by number
    word_shards: np.ndarray  # the same of words


def _local(folder: str) -> str:
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"workers map the model's files into memory: mount {folder} and name it as file:/...")
    path = folder.removeprefix("file:")
    return "/" + path.lstrip("/")


def _sums(stats: DataFrame, n: int) -> list[int]:
    row = stats.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(f"s{k}") for k in range(n)]).first()
    return [int(x) for x in row]


def train(docs: DataFrame) -> Model:
    """Count all of ``docs`` (text) and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_SHARD_BITS, max(0, (int(size) // SHARD_BYTES).bit_length()))
    where = shared_folder(spark, "model")
    folder = _local(where)
    os.makedirs(folder, exist_ok=True)
    stats = keep(merge_words(merge_pairs(count_pairs(docs, bits), folder, bits), folder), "stats")
    *pair_counts, n_tokens = _sums(stats.where("words = 0"), 5)
    *word_counts, more, contexts, n_words = _sums(stats.where("words = 1"), 7)
    d = discounts(*word_counts)
    rest = float(d[1] * word_counts[0] + d[2] * word_counts[1] + d[3] * more) / contexts if contexts else 1.0
    return Model(folder, bits, n_tokens, n_words, discounts(*pair_counts), d, contexts, rest,
                 *(_written(stats.where(F.col("words") == k), bits) for k in (0, 1)))


def _written(stats: DataFrame, bits: int) -> np.ndarray:
    """Which shards there are; at most 2 ** MOST_SHARD_BITS numbers come to the driver."""
    out = np.zeros(1 << bits, bool)
    out[[r.shard for r in stats.select(F.element_at("stats", -1).alias("shard")).distinct().collect()]] = True
    return out


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, part: str) -> np.ndarray:
    """A written array; that its file is not there is an error, not an empty shard."""
    return np.load(f"{folder}/{name}-{part}.npy", mmap_mode="r")


def _look_up(model: Model, table: str, key: np.ndarray, *parts: str) -> list[np.ndarray]:
    """Values of sorted keys in a table's mapped arrays; 0 where a key is missing."""
    shape = [(len(key), 3) if p == "kinds" else len(key) for p in parts]
    out = [np.zeros(s, np.int64) for s in shape]
    at = _shards(key, model.bits)
    written = model.word_shards if table == "words" else model.pair_shards
    for s in np.flatnonzero(np.diff(at)):
        if not written[s]:
            continue
        there = _mapped(model.folder, f"{table}-{s}", "key")
        needle = key[at[s]:at[s + 1]]
        place = np.minimum(np.searchsorted(there, needle), len(there) - 1)
        hit = there[place] == needle
        for values, part in zip(out, parts):
            values[at[s]:at[s + 1]][hit] = _mapped(model.folder, f"{table}-{s}", part)[place[hit]]
    return out


def token_scores(model: Model, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count and log10 probability of each token after the one before it."""
    seen, at = np.unique(word, return_inverse=True)
    count, contexts = _look_up(model, "words", seen, "n", "contexts")
    d = model.word_discount[np.minimum(contexts, 3)]
    alone = ((contexts - d) / max(model.all_contexts, 1) + model.rest / (model.words + 1))[at]
    heads, head_at = np.unique(before, return_inverse=True)
    total, kinds = _look_up(model, "contexts", heads, "total", "kinds")
    some = np.maximum(total, 1)
    rest = np.where(total > 0, kinds @ model.pair_discount[1:] / some, 1.0)[head_at]
    pairs, pair_at = np.unique(pair_key(before, word), return_inverse=True)
    n = _look_up(model, "pairs", pairs, "n")[0][pair_at]
    own = (n - model.pair_discount[np.minimum(n, 3)]) / some[head_at]
    return count[at], np.log10(own + rest * alone)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text"), WIDE):
                word, before, offsets = tokens(words(c))
                count, logs = token_scores(model, word, before)
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                at = offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.first, c.rows), pa.array(np.diff(offsets)),
                     pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                     pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those outside the held-out fold."""
    docs = documents(read(spark, sf_dir, "documents"))
    held_out = fold("doc_id", 7) == 2
    model = train(docs.where(~held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
