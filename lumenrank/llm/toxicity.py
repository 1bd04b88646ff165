"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, tokens get theirs by explanation: a spelling (a word or
its first 4, 5 or 6 bytes) that is far more frequent in documents labelled 1 than in the
others explains those it occurs in; the spelling that explains most is taken, its
documents are set aside, and so on.  Tokens of label-1 documents with such a spelling
are labelled toxic.  Taking the best first keeps words out that only share copies of a
document with a toxic one.

The field has two states, a weight for each spelling (hashed) and for each change of
state.  A chain is a line of text, in pieces of at most ``CHAIN`` words.  Forward-backward
gives each token's marginal; a document's score is a logistic curve over its largest
marginal and the sum of its marginals, and tokens of 1/2 or more are its spans.

Training takes at most ``MAX_TRAIN`` documents of each class, chosen by a hash of the id,
with their whole texts.  Scoring is one pass, no shuffle.

Defined results: null text is empty and gets the score of a text without toxic tokens;
null labels are not used; if a class is missing, every score is the share of label 1
(0.5 without any label); repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WIDE, BYTE_VALUE, LETTER_OR_DIGIT, LOWER, Chunk, Words, _powers, chunks, mix, words
from .quality import _logistic, _sigmoid, labelled
from .tables import documents, fold, pick, read

MAX_TRAIN = 2_000
CHAIN = 128
PREFIXES = (4, 5, 6)
BITS = 18
LIFT, LEAST_DOCUMENTS = 20.0, 3
CUT = 0.3


def spellings(c: Chunk, w: Words) -> np.ndarray:
    """Bucket of each token's word and prefixes, a column each."""
    data = LOWER[c.data]
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    out = [w.hash]
    for k in PREFIXES:
        end = np.minimum(w.start + k, w.end)
        out.append(mix((total[end] - total[w.start]) * down[w.start] + np.uint64(1000 + k)))
    return np.stack([x >> np.uint64(64 - BITS) for x in out], axis=1).astype(np.int32)


def chains(c: Chunk, w: Words) -> np.ndarray:
    """First token of each chain, and the number of tokens at the end."""
    n = len(w.start)
    if not n:
        return np.zeros(1, np.int64)
    line = np.concatenate([[0], np.cumsum(c.data == 10)])[w.start]
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    new[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
    first = np.flatnonzero(new)
    new[(np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % CHAIN == 0] = True
    return np.append(np.flatnonzero(new), n)


class Field(NamedTuple):
    weight: np.ndarray      # per bucket, what a spelling adds to the log odds of the toxic state
    change: np.ndarray      # 2 x 2, log weight of going from a state to the next; diagonal too
    bias: float
    curve: np.ndarray       # logistic curve over (largest marginal, log1p of their sum, 1)


def forward_backward(field: Field, buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Odds of each token by itself, and the toxic state's share of what comes up to it and of
    what follows it; all chains go side by side, the longest first."""
    n = len(buckets)
    odds = np.exp(np.clip(field.weight[buckets].sum(axis=1) + field.bias, -30, 30)) if n else np.zeros(0)
    t = np.exp(field.change)
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    start, length = bounds[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -k, "left")) for k in range(longest)]  # chains longer than k
    forward = np.zeros(n)
    a = np.zeros(0)
    for k in range(longest):
        at = start[:active[k]] + k
        if k == 0:
            one, zero = odds[at], np.ones(len(at))
        else:
            a = a[:len(at)]
            zero = (1 - a) * t[0, 0] + a * t[1, 0]
            one = ((1 - a) * t[0, 1] + a * t[1, 1]) * odds[at]
        a = one / (one + zero)
        forward[at] = a
    backward = np.zeros(n)
    b = np.zeros(0)  # weight of what follows from state 1, of both states' sum
    for k in range(longest - 1, -1, -1):
        at = start[:active[k]] + k
        back = np.full(len(at), 0.5)
        if len(b):
            nxt = start[:len(b)] + k + 1
            r1, r0 = b * odds[nxt], 1 - b
            one = t[1, 0] * r0 + t[1, 1] * r1
            back[:len(b)] = one / (one + t[0, 0] * r0 + t[0, 1] * r1)
        backward[at] = b = back
    return odds, forward, backward


def marginals(field: Field, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each token."""
    _, f, b = forward_backward(field, buckets, bounds)
    return f * b / (f * b + (1 - f) * (1 - b))


def pair_marginals(field: Field, odds: np.ndarray, forward: np.ndarray, backward: np.ndarray,
                   here: np.ndarray) -> np.ndarray:
    """Expected number of each change of state from tokens ``here`` to their next ones."""
    f, b, o, t = forward[here], backward[here + 1], odds[here + 1], np.exp(field.change)
    parts = [[(1 - f) * t[0, 0] * (1 - b), (1 - f) * t[0, 1] * o * b], [f * t[1, 0] * (1 - b), f * t[1, 1] * o * b]]
    whole = parts[0][0] + parts[0][1] + parts[1][0] + parts[1][1]
    return np.array([[(x / whole).sum() for x in row] for row in parts])


def explain(buckets: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which tokens are toxic, from the labels of their documents."""
    size, kinds = 1 << BITS, buckets.shape[1]
    keys = (buckets + np.arange(kinds, dtype=np.int64) * size)
    pairs = np.unique(keys.ravel() * len(label) + np.repeat(doc, kinds))
    pairs = np.column_stack(np.divmod(pairs, len(label)))
    toxic = label[pairs[:, 1]] == 1
    in_toxic = np.bincount(pairs[toxic, 0], minlength=size * kinds)
    in_clean = np.bincount(pairs[~toxic, 0], minlength=size * kinds)
    lift = in_toxic / max(1, (label == 1).sum()) / ((in_clean + 0.5) / max(1, (label == 0).sum()))
    usable = (in_toxic >= LEAST_DOCUMENTS) & (lift >= LIFT)
    left = pairs[toxic & usable[pairs[:, 0]]]
    chosen = np.zeros(size * kinds, bool)
    while len(left):
        many = np.bincount(left[:, 0], minlength=size * kinds)
        if many.max() < LEAST_DOCUMENTS:
            break
        best = np.flatnonzero(many == many.max())
        # of those that explain as much, the one least seen elsewhere, then the whole word
        pick_one = min(best.tolist(), key=lambda k: (in_clean[k], in_toxic[k], k))
        chosen[pick_one] = True
        left = left[~np.isin(left[:, 1], left[left[:, 0] == pick_one, 1])]
    return chosen[keys].any(axis=1) & (label[doc] == 1)


def fit_field(buckets: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rounds: int = 40,
              rate: float = 0.7, penalty: float = 0.05) -> Field:
    """Conditional likelihood by gradient steps with a rate per weight."""
    size = 1 << BITS
    y = toxic.astype(float)
    field = Field(np.zeros(size), np.zeros((2, 2)), -2.0, np.zeros(3))
    inner = np.ones(len(y), bool)
    inner[bounds[1:] - 1] = False   # tokens that have a next one in their chain
    here = np.flatnonzero(inner)
    seen_w, seen_t, seen_b = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    want = np.array([[((y[here] == i) & (y[here + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(rounds):
        odds, f, b = forward_backward(field, buckets, bounds)
        gap = y - f * b / (f * b + (1 - f) * (1 - b))
        g = sum(np.bincount(buckets[:, k], gap, size) for k in range(buckets.shape[1])) - penalty * field.weight
        gt = want - pair_marginals(field, odds, f, b, here) - penalty * field.change
        gb = float(gap.sum())
        seen_w += g * g
        seen_t += gt * gt
        seen_b += gb * gb
        field = field._replace(weight=field.weight + rate * g / np.sqrt(seen_w),
                               change=field.change + 0.3 * rate * gt / np.sqrt(seen_t),
                               bias=field.bias + rate * gb / np.sqrt(seen_b))
    return field


def evidence(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest marginal and log1p of the marginals' sum, per document, and a 1."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    top = np.zeros(len(offsets) - 1)
    some = np.diff(offsets) > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, offsets[:-1][some])
    return np.column_stack([top, np.log1p(np.bincount(rows, p, len(offsets) - 1)), np.ones(len(top))])


def fit(texts: list[str], label: np.ndarray) -> Field:
    """A field from whole texts and their labels."""
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        flat = np.array([0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))])
        return Field(np.zeros(1 << BITS), np.zeros((2, 2)), -30.0, flat)
    buckets, bounds, doc, offsets = [], [0], [], [0]
    for c in chunks(pa.array(texts, pa.string()), WIDE):
        w = words(c, LETTER_OR_DIGIT)
        buckets.append(spellings(c, w))
        bounds += (chains(c, w)[1:] + offsets[-1]).tolist() if len(w.start) else []
        doc.append(w.row + c.first)
        offsets += (w.offsets[1:] + offsets[-1]).tolist()
    if not offsets[-1]:
        return fit([], label[label == 1])
    x, d, at = np.concatenate(buckets), np.concatenate(doc), np.array(bounds)
    field = fit_field(x, at, explain(x, d, label))
    seen = evidence(marginals(field, x, at), np.array(offsets))
    return field._replace(curve=_logistic(seen, label.astype(float), penalty=0.5))


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2,
          max_rows: int = MAX_TRAIN) -> Field:
    known = pick(labels, doc_id="bigint", toxic="int")
    rows = []
    for value in (0, 1):
        rows += labelled(docs, known.where(F.col("toxic") == value), "toxic", parts, held_out, max_rows
                         ).select("text", "label").orderBy("text").collect()
    return fit([r.text for r in rows], np.array([r.label for r in rows], int))


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, and the toxic spans as arrays of code points (starts, ends)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            for c in chunks(batch.column("text"), WIDE):
                w = words(c, LETTER_OR_DIGIT)
                p = marginals(f, spellings(c, w), chains(c, w))
                score = _sigmoid(evidence(p, w.offsets) @ f.curve)
                hit = np.flatnonzero(p >= 0.5)
                before = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])  # code points
                row = np.searchsorted(w.offsets, hit, "right") - 1
                cuts = np.searchsorted(row, np.arange(c.rows + 1))
                base = before[c.offsets[row]] if len(hit) else 0
                spans = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((before[x[hit]] - base).astype(np.int64)))
                         for x in (w.start, w.end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.first, c.rows), pa.array(score), *spans],
                    names=["doc_id", "score", "starts", "ends"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, starts array<long>, ends array<long>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    out = tag(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"),
                      F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a, b)), ",").alias("spans"))
