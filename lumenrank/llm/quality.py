"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 over one labelled 0) give a logistic loss on
the differences of their features, with no intercept; its weights score any document.
The cut is a quantile of the training scores: the share labelled 0.  For a score
between 0 and 1 a logistic curve is fitted over the training scores.

Features come from the text alone: how words are spelled, repeated and punctuated.

Training takes every labelled document outside the held-out fold.  Its features (a few
numbers) are dealt by a hash of the id into blocks of about ``BLOCK`` rows, and pairs are
drawn inside blocks so that each row is in one at least; a class that is too rare for the
blocks has its rows in several.  A Newton step adds up the blocks' slopes, the mean, the
deviation and the logistic curve are sums over all rows, and the cut is an exact order
statistic.  The driver gets sums only, one row a block.  Scoring is one pass over all
documents without a shuffle.

Defined results: null text is empty and has a score; a null id counts as empty text for
the fold; documents with several labels train once per label, labels other than 0 and 1 not at all;
if one class is missing, every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, Chunk, chunks, distinct_per_row, words
from .tables import documents, fold, keep, pick, read, scratch

MAX_TRAIN = 20_000          # default of ``labelled``; ``train`` takes all rows
PAIRS_PER_DOCUMENT = 20
BLOCK = 2_000               # training rows of a block, 224 kB of features
RARE_ROWS = 50              # rows of the rarer class that a block should have
RANGE_COUNTS, SORTED_ROWS = 4_096, 10_000
CUT = 0.3
_CLASS = np.zeros((256, 5), np.int32)  # upper, digit, mark, sign, bar
_CLASS[65:91, 0] = _CLASS[48:58, 1] = 1
_CLASS[[ord(x) for x in ".,;:'\"()-?"], 2] = 1
_CLASS[[ord(x) for x in "!#$%&*+/<=>@[\\]^_`{}~"], 3] = 1
_CLASS[ord("|"), 4] = 1
N_FEATURES = 14


def features(c: Chunk) -> np.ndarray:
    """One row of numbers per text of a chunk."""
    w = words(c, lower=False)
    size = np.maximum(np.diff(c.offsets), 1)
    count = np.diff(w.offsets)
    some = np.maximum(count, 1)
    row = w.row
    total = lambda x, r: np.bincount(r, x, c.rows)
    byte_row = np.repeat(np.arange(c.rows), np.diff(c.offsets))
    kinds = [total(_CLASS[c.data, k], byte_row) for k in range(5)]
    lines = total(c.data == 10, byte_row) + 1
    length = w.end - w.start
    # words without a small letter, without any letter, and equal to the word before
    low = np.concatenate([[0], np.cumsum((c.data >= 97) & (c.data <= 122) | (c.data >= 128))])
    letter = np.concatenate([[0], np.cumsum((LOWER[c.data] >= 97) & (LOWER[c.data] <= 122) | (c.data >= 128))])
    small, letters = low[w.end] - low[w.start], letter[w.end] - letter[w.start]
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    distinct = np.diff(distinct_per_row(w.hash, w.offsets)[1])
    mean = total(length, row) / some
    return np.column_stack([
        np.sqrt(kinds[0] / size), np.sqrt(kinds[1] / size), kinds[2] / size, np.sqrt(kinds[3] / some),
        np.sqrt(kinds[4] / some), np.sqrt(total((small == 0) & (letters > 1), row) / some),
        np.sqrt(total(letters == 0, row) / some), np.sqrt(total(same, row) / some),
        distinct / some, np.log1p(distinct) / np.log1p(some), np.log1p(count) / 10, np.minimum(mean, 30) / 10,
        np.sqrt(lines / some), np.sqrt(total(length > 24, row) / some)])


class Ranker(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float
    cut: float          # quantile of the training scores below which a document is rejected

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, penalty: float, rounds: int = 40) -> np.ndarray:
    """Weights at which the slope is 0, by Newton steps; ``sums`` gives slope and bend of the loss at some weights."""
    w = np.zeros(size)
    for _ in range(rounds):
        slope, bend = sums(w)
        step = np.linalg.solve(bend + (penalty + 1e-9) * np.eye(size), slope + penalty * w)
        w -= step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _slope_and_bend(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _sigmoid(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton steps (``x`` has its intercept column, if any)."""
    return _newton(lambda w: _slope_and_bend(x, y, w), x.shape[1], penalty, rounds)


class Block(NamedTuple):
    number: int
    x: np.ndarray
    label: np.ndarray
    own: np.ndarray     # False: a row of the rarer class that is lent by another block

    def pairs(self, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows labelled 1 and 0 to compare: ``pairs`` for each row of the rarer class, and one at least for any other."""
        good, bad = np.flatnonzero(self.label == 1), np.flatnonzero(self.label == 0)
        few, many = sorted((good, bad), key=len)
        if not len(few):
            return few, few
        n = max(len(few) * pairs, len(many))
        rng = np.random.default_rng([seed, self.number])
        other = np.concatenate([rng.permutation(many) for _ in range(-(-n // len(many)))])[:n]
        first = np.resize(few, n)
        return (first, other) if few is good else (other, first)


def deal(rows: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """A row per block of about ``size`` of the ``rows`` (doc_id, label, x): its features, labels and owners as bytes."""
    blocks = sum(counts.values()) // size + 1
    copies = {label: min(blocks, -(-RARE_ROWS * blocks // n)) for label, n in counts.items()}
    lent = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    dealt = rows.select("label", "x", lent.alias("lent"), F.xxhash64("doc_id").alias("_h")).select(
        "label", "x", (F.col("lent") == 0).alias("own"), F.pmod(F.pmod("_h", F.lit(blocks)) + F.col("lent"), F.lit(blocks)).cast("int").alias("block"))

    def gather(t: pa.Table) -> pa.Table:
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
        label, own = t["label"].to_numpy().astype(np.uint8), t["own"].to_numpy().astype(np.uint8)
        order = np.lexsort((*x.T[::-1], label))
        return pa.table({"block": t["block"][:1].cast(pa.int32()), "x": [x[order].tobytes()],
                         "label": [label[order].tobytes()], "own": [own[order].tobytes()]})

    return dealt.groupBy("block").applyInArrow(gather, "block int, x binary, label binary, own binary")


def _of_blocks(numbers: Callable[[Block], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["block"], np.frombuffer(r["x"]).reshape(-1, N_FEATURES),
                          np.frombuffer(r["label"], np.uint8), np.frombuffer(r["own"], bool))
                yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int32()), pa.array([numbers(b)], pa.list_(pa.float64()))],
                                                 names=["block", "n"])
    return run


def per_block(blocks: DataFrame, numbers: Callable[[Block], np.ndarray]) -> np.ndarray:
    """Some numbers of each block, a row each, in the order of the blocks so that sums are always the same."""
    rows = blocks.mapInArrow(_of_blocks(numbers), "block int, n array<double>").collect()
    return np.array([r.n for r in sorted(rows)], float)


def at_rank(values: DataFrame, rank: int) -> float:
    """The value of a rank (from 0) of the column ``raw``, by counts in ever narrower ranges of values."""
    while True:
        lo, hi, n = values.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
        if lo == hi:
            return lo
        if n <= SORTED_ROWS:
            return sorted(r.raw for r in values.collect())[rank]
        place = F.width_bucket("raw", F.lit(lo), F.lit(hi), F.lit(RANGE_COUNTS))
        for r in sorted(values.groupBy(place.alias("b")).agg(F.count("raw").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).collect()):
            if rank < r.n:
                break
            rank -= r.n
        values = values.where(F.col("raw").between(r.lo, r.hi))


def fit(rows: DataFrame, pairs: int = PAIRS_PER_DOCUMENT, seed: int = 7, block: int = BLOCK) -> Ranker:
    """A ranker from all ``rows`` (doc_id, label, x); to be called inside ``scratch``."""
    counts = {0: 0, 1: 0, **{r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}}
    n = sum(counts.values())
    share = counts[1] / n if n else 0.5
    if not all(counts.values()):
        even = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, even, -np.inf)
    blocks = keep(deal(rows, counts, block), "training-blocks")

    def moments(b: Block) -> np.ndarray:
        x = b.x[b.own]
        mean = x.mean(0) if len(x) else np.zeros(N_FEATURES)
        return np.concatenate([[len(x), len(b.pairs(pairs, seed)[0])], mean, ((x - mean) ** 2).sum(0)])

    found = per_block(blocks, moments)
    size, means = found[:, :1], found[:, 2:2 + N_FEATURES]
    mean = (size * means).sum(0) / n
    scale = np.sqrt((found[:, 2 + N_FEATURES:] + size * (means - mean) ** 2).sum(0) / n) + 1e-6
    start = Ranker(mean, scale, np.zeros(N_FEATURES), 1.0, 0.0, -np.inf)

    def added(numbers: Callable[[Block], tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
        total = per_block(blocks, lambda b: np.concatenate([a.ravel() for a in numbers(b)])).sum(0)
        return total[:k], total[k:].reshape(k, k)

    def of_pairs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def numbers(b: Block) -> tuple[np.ndarray, np.ndarray]:
            z = start.scaled(b.x)
            winner, loser = b.pairs(pairs, seed)
            return _slope_and_bend(z[winner] - z[loser], np.ones(len(winner)), w)
        return added(numbers, N_FEATURES)

    ranker = start._replace(weight=_newton(of_pairs, N_FEATURES, penalty=found[:, 1].sum() * 1e-4))

    def of_curve(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def numbers(b: Block) -> tuple[np.ndarray, np.ndarray]:
            raw = ranker.raw(b.x[b.own])
            return _slope_and_bend(np.column_stack([raw, np.ones(len(raw))]), b.label[b.own].astype(float), w)
        return added(numbers, 2)

    slope, shift = _newton(of_curve, 2, penalty=1e-3)
    raw = keep(blocks.mapInArrow(_of_blocks(lambda b: ranker.raw(b.x[b.own])), "block int, n array<double>")
               .select(F.explode("n").alias("raw")), "training-scores")
    place = (n - 1) * (1 - share)   # between two ranks
    low, part = int(place), place - int(place)
    below = at_rank(raw, low)
    above = at_rank(raw, low + 1) if part else below
    return ranker._replace(slope=float(slope), shift=float(shift), cut=float(below + part * (above - below)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int,
             max_rows: int = MAX_TRAIN) -> DataFrame:
    """Whole texts and labels outside the held-out fold, about ``max_rows`` at most, never more than 1.2 times that."""
    rows = pick(labels, doc_id="bigint", **{column: "int"}).where(
        F.col(column).isNotNull() & (fold("doc_id", parts) != held_out)).withColumnRenamed(column, "label")
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, max_rows / max(n, 1)) * 1_000_000))
    rows = F.broadcast(rows.limit(max_rows * 6 // 5))
    return documents(docs).join(rows, "doc_id")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            x = features(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(c.first, c.rows), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> Ranker:
    """A ranker from every labelled document outside the held-out fold; texts stay where they are read."""
    known = pick(labels, doc_id="bigint", quality="int").where(F.col("quality").isin(0, 1)).withColumnRenamed("quality", "label")
    rows = documents(docs).where(F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held_out)).mapInArrow(
        _feature_rows, "doc_id long, x array<double>").join(known, "doc_id").select("doc_id", "label", "x")
    with scratch(docs.sparkSession):
        return fit(keep(rows, "training-rows"))


def add_scores(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_raw`` and ``_score`` of each row's text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if not len(batch):
                continue
            x = np.concatenate([features(c) for c in chunks(column)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.raw(x)), pa.array(ranker.score(x))],
                                             names=[*batch.schema.names, "_raw", "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{schema}, _raw double, _score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    ranker = train(docs, read(spark, sf_dir, "labels"))
    out = add_scores(documents(docs), ranker)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= CUT).cast("int").alias("predicted"))
