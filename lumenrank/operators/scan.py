"""One pass of a stated query set over document blocks: extremes, or the top k for a grid of weights.

A block is a run of documents with postings, vectors or both (``lexical.build_index`` with
vectors keeps them together).  The queries go to the tasks; per task only extremes or k rows
per (weight, query) come out, so no (query, document) pair is ever exchanged.  A query set
over the bounds is cut by query id into sets of bounded size, each with a pass of its own.

Scores by weight ``alpha``: 0 is BM25 (documents with a common term only), 1 the raw
vector score, and in between ``alpha * s + (1 - alpha) * l`` of the min-max normalised
scores, where a missing side counts 0.  Values are rounded to nine decimals; ties go to
the smaller document id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators import lexical, ranking, topk, vector_search
from lumenrank.session import stored

QUERY_ROWS = 20_000
QUERY_VALUES = 8_000_000        # vector components of a query set (64 MB)
VECTOR_BLOCK = 1024             # documents scored at once where there are no postings
GROUP_VALUES = 8_000_000        # scores and maxima of the documents of blocks that are scored together
GROUP_VECTORS = 500_000         # their vectors

TOPK = "alpha double, query_id string, doc_id string, score double"
EXTREMES = "query_id string, smin double, smax double, lmin double, lmax double"


class Report:
    """How many (query, block) pairs had a common term, and how many of them were scored."""

    def __init__(self, spark):
        self.offered, self.read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


@dataclass
class Scales:
    """Per query: extremes of both sides, and the last lexical candidate where their number is capped."""

    smin: np.ndarray
    smax: np.ndarray
    lmin: np.ndarray
    lmax: np.ndarray
    last: list | None = None        # (score, doc_id) per query, or None


@dataclass
class QuerySet:
    """A bounded set of queries as the tasks get it."""

    ids: list[str]
    weights: lexical.TermWeights | None = None
    vectors: vector_search.Dense | vector_search.Multi | None = None
    scales: Scales | None = None
    number: dict[str, int] = field(default_factory=dict)


class Block:
    """Documents with postings, vectors or both; ``scores`` are approximate vector scores of all queries, if made before."""

    def __init__(self, ids: np.ndarray, postings: lexical.BlockPostings | lexical.GroupPostings | None, vectors,
                 scores: np.ndarray | None = None):
        self.ids, self.postings, self.vectors, self.scores = ids, postings, vectors, scores

    def bound(self, n: int) -> np.ndarray:
        return self.postings.bound if self.postings is not None else np.zeros(n)

    def tile(self, queries: QuerySet) -> int:
        return queries.vectors.tile(self.vectors) if self.scores is None else max(1, lexical.CELLS // max(len(self.ids), 1))

    def approximate(self, queries: QuerySet, lo: int, hi: int) -> np.ndarray:
        return queries.vectors.approximate(lo, hi, self.vectors) if self.scores is None else self.scores[lo:hi]


class Source:
    """Where blocks come from: an index, or a table of vectors."""

    def __init__(self, index: lexical.LexicalIndex | None = None, doc_vecs: DataFrame | None = None, kind: str = "dense"):
        self.index, self.kind = index, kind
        column = vector_search.COLUMN[kind]
        if index is not None:
            self.frame = index.blocks
        else:
            self.frame = doc_vecs.select("doc_id", F.col(column).alias("vectors"))

    def columns(self, lexical_side: bool, semantic_side: bool) -> DataFrame:
        if self.index is None:
            return self.frame
        if semantic_side and "vectors" not in self.frame.columns:
            raise ValueError("the index was built without vectors")
        names = ["ids"] + [c for c in self.frame.columns if c not in ("ids", "vectors")] * lexical_side + ["vectors"] * semantic_side
        return self.frame.select(*names)

    def blocks(self, semantic_side: bool) -> Callable[[Iterator[pa.RecordBatch], QuerySet], Iterator[Block]]:
        make = vector_search.KINDS[self.kind]
        if self.index is None:
            def of_vectors(batches: Iterator[pa.RecordBatch], queries: QuerySet) -> Iterator[Block]:
                for batch in batches:
                    for i in range(0, len(batch), VECTOR_BLOCK):
                        part = batch.slice(i, VECTOR_BLOCK)
                        yield Block(np.array(part.column("doc_id").to_pylist(), object), None, make(part.column("vectors")))
            return of_vectors
        k1, b, avgdl = self.index.k1, self.index.b, self.index.avgdl

        def parts(batch: pa.RecordBatch, queries: QuerySet) -> Iterator[tuple[list, dict | None, pa.Array | None]]:
            """Ids, postings and vectors of each block, as they came."""
            names = batch.schema.names
            numbers = [n for n in names if n in ("lens", "ends", "docs", "tfs", "max_tf", "min_len")]
            if numbers and queries.weights is not None:
                terms = batch.column("terms")
                places = queries.weights.places(terms.flatten())
                ends = np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))
            for i in range(len(batch)):
                ids, row = batch.column("ids")[i].as_py(), None
                if numbers and queries.weights is not None:
                    row = {n: batch.column(n)[i].values.to_numpy() for n in numbers}
                    row |= {"ids": ids, "places": places[ends[i - 1] if i else 0:ends[i]]}
                yield ids, row, batch.column("vectors")[i].values if "vectors" in names else None

        def postings(row: dict, queries: QuerySet) -> lexical.BlockPostings:
            return lexical.BlockPostings(row, queries.weights, len(queries.ids), k1, b, avgdl)

        def of_index(batches: Iterator[pa.RecordBatch], queries: QuerySet) -> Iterator[Block]:
            for batch in batches:
                for ids, row, lists in parts(batch, queries):
                    yield Block(np.array(ids, object), postings(row, queries) if row else None, make(lists) if lists is not None else None)

        def of_groups(batches: Iterator[pa.RecordBatch], queries: QuerySet) -> Iterator[Block]:
            """Several blocks as one: a call for each of them costs more than the products of its few documents."""
            group, documents, held = [], 0, 0
            most = max(1, GROUP_VALUES // max(len(queries.ids) + queries.vectors.values, 1))
            for batch in batches:
                for part in parts(batch, queries):
                    size, n = len(part[0]), vector_search.count(part[2])
                    if group and (documents + size > most or held + n > GROUP_VECTORS):
                        yield joined(group, queries)
                        group, documents, held = [], 0, 0
                    group.append(part)
                    documents, held = documents + size, held + n
            if group:
                yield joined(group, queries)

        def joined(group: list, queries: QuerySet) -> Block:
            vectors = make(pa.concat_arrays([lists for _, _, lists in group]))
            n, step = len(queries.ids), queries.vectors.tile(vectors)
            scores = np.concatenate([queries.vectors.approximate(lo, min(lo + step, n), vectors) for lo in range(0, n, step)])
            made = [postings(row, queries) for _, row, _ in group if row]
            ids = np.array([name for names, _, _ in group for name in names], object)
            return Block(ids, lexical.GroupPostings(made) if made else None, vectors, scores)

        return of_groups if semantic_side and self.kind == "maxsim" else of_index


def _norm(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(high == low, 1.0, (x - low) / (high - low))


# ---------------------------------------------------------------- passes inside a task

def _extremes(blocks: Iterator[Block], queries: QuerySet) -> pa.RecordBatch:
    n = len(queries.ids)
    low, high, lmin, lmax = (np.full(n, x) for x in (np.inf, -np.inf, np.inf, -np.inf))
    for block in blocks:
        if block.postings is not None:
            some = np.flatnonzero(block.bound(n) > 0)
            step = max(1, lexical.CELLS // max(len(block.ids), 1))
            for i in range(0, len(some), step):
                rows = some[i:i + step]
                scores = block.postings.scores(rows)
                hit = scores > 0
                lmin[rows] = np.minimum(lmin[rows], np.where(hit, scores, np.inf).min(axis=1))
                lmax[rows] = np.maximum(lmax[rows], np.where(hit, scores, -np.inf).max(axis=1))
        if block.vectors is not None and queries.vectors is not None and not block.vectors.missing.all():
            there = np.flatnonzero(~block.vectors.missing)
            step = block.tile(queries)
            for lo in range(0, n, step):
                hi = min(lo + step, n)
                s = block.approximate(queries, lo, hi)[:, there]
                room = vector_search.ERROR * np.maximum(1.0, np.abs(s).max(axis=1))
                for best, sign in ((low, 1), (high, -1)):
                    edge = np.minimum(sign * best[lo:hi], (sign * s).min(axis=1)) + 2 * room
                    q, d = np.nonzero(sign * s <= edge[:, None])
                    if len(q):
                        exact = sign * queries.vectors.exact(q + lo, there[d], block.vectors)
                        at = sign * best[lo:hi]
                        np.minimum.at(at, q, exact)
                        best[lo:hi] = sign * at
    rows = np.flatnonzero(np.isfinite(low) | np.isfinite(lmin))
    value = lambda x: pa.array(x[rows], pa.float64(), mask=~np.isfinite(x[rows]))
    return pa.RecordBatch.from_arrays(
        [pa.array([queries.ids[i] for i in rows], pa.string()), value(low), value(high),
         value(topk.rounded(np.where(np.isfinite(lmin), lmin, 0.0)) + np.where(np.isfinite(lmin), 0.0, np.inf)),
         value(topk.rounded(np.where(np.isfinite(lmax), lmax, 0.0)) + np.where(np.isfinite(lmax), 0.0, np.inf))],
        names=["query_id", "smin", "smax", "lmin", "lmax"])


def _lexical_norm(raw: np.ndarray, rows: np.ndarray, ids: np.ndarray, scales: Scales) -> np.ndarray:
    """Normalised lexical scores of a matrix of raw ones; 0 for what is no candidate."""
    scores = topk.rounded(raw)
    inside = raw > 0
    if scales.last is not None:
        for i, q in enumerate(rows):
            if scales.last[q] is not None:
                score, name = scales.last[q]
                inside[i] &= (scores[i] > score) | ((scores[i] == score) & (ids <= name))
    return np.where(inside, _norm(scores, scales.lmin[rows, None], scales.lmax[rows, None]), 0.0)


def _best(blocks: Iterator[Block], queries: QuerySet, alphas: Sequence[float], k: int, report: Report | None) -> topk.RunningTopK:
    n = len(queries.ids)
    best = topk.RunningTopK(len(alphas) * n, k)
    scales = queries.scales
    for block in blocks:
        size, bound = len(block.ids), block.bound(n)
        vectors = queries.vectors if block.vectors is not None else None
        step = min(block.tile(queries) if vectors is not None else n, max(1, lexical.CELLS // max(size, 1)))
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            rows = np.arange(lo, hi)
            sem = block.approximate(queries, lo, hi) if vectors is not None else None
            slack = topk.SLACK + np.zeros(hi - lo)
            s = None
            if sem is not None and scales is not None:
                s = _norm(sem, scales.smin[lo:hi, None], scales.smax[lo:hi, None])
                s[:, block.vectors.missing] = 0.0
                size_of = np.maximum(1.0, np.maximum(np.abs(scales.smin[lo:hi]), np.abs(scales.smax[lo:hi])))
                width = scales.smax[lo:hi] - scales.smin[lo:hi]
                slack = slack + np.where(width > 0, vector_search.ERROR * size_of / np.where(width > 0, width, 1), 0)
            # which queries can still gain from this block, by weight
            reach = {}
            for a, alpha in enumerate(alphas):
                least = best.least[a * n + lo:a * n + hi]
                if alpha == 0.0:
                    top = np.where(bound[lo:hi] > 0, bound[lo:hi], -np.inf)
                elif alpha == 1.0:
                    top = sem.max(axis=1)
                    largest = np.maximum(np.abs(top), np.abs(sem.min(axis=1)))
                else:
                    high = np.where(bound[lo:hi] > 0, np.clip(_norm(bound[lo:hi], scales.lmin[lo:hi], scales.lmax[lo:hi]), 0, 1), 0.0)
                    top = alpha * (s.max(axis=1) if s is not None else 0.0) + (1 - alpha) * high
                room = vector_search.ERROR * np.maximum(1.0, np.abs(top)) if alpha == 1.0 else 0.0
                reach[a] = top >= least - slack - room
            lex = np.zeros((hi - lo, size)) if min(alphas) < 1.0 else None
            if lex is not None and block.postings is not None:
                wants = np.zeros(hi - lo, bool)
                for a, alpha in enumerate(alphas):
                    wants |= reach[a] & (alpha < 1.0)
                wanted = rows[wants & (bound[lo:hi] > 0)]
                if report is not None:
                    report.offered.add(int((bound[lo:hi] > 0).sum()))
                    report.read.add(len(wanted))
                lex[wanted - lo] = block.postings.scores(wanted)
            lnorm = _lexical_norm(lex, rows, block.ids, scales) if scales is not None and lex is not None else None
            # exact vector scores of this tile, where several weights may ask for them
            known = np.full((hi - lo, size), np.nan) if len(alphas) > 1 else None

            def exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
                if known is None:
                    return vectors.exact(q + lo, d, block.vectors)
                new = np.isnan(known[q, d])
                if new.any():
                    known[q[new], d[new]] = vectors.exact(q[new] + lo, d[new], block.vectors)
                return known[q, d]

            for a, alpha in enumerate(alphas):
                q = np.flatnonzero(reach[a])
                if not len(q):
                    continue
                if alpha == 0.0:
                    value = np.where(lex[q] > 0, lex[q], -np.inf)
                elif alpha == 1.0:
                    value = sem if len(q) == len(sem) else sem[q]
                    if block.vectors.missing.any():
                        value = np.where(block.vectors.missing, -np.inf, value)
                else:
                    value = alpha * (s[q] if s is not None else 0.0) + (1 - alpha) * lnorm[q]
                edge = best.least[a * n + lo + q] - slack[q]
                if alpha == 1.0:
                    edge = edge - vector_search.ERROR * np.maximum(1.0, largest[q])
                def raise_edge(at: np.ndarray) -> None:
                    """The k-th of this block is the better edge for lists that are short or have many entries above theirs."""
                    if size > k and len(at):
                        kth = np.partition(value[at], size - k, axis=1)[:, size - k] - 2 * slack[q[at]]
                        edge[at] = np.maximum(edge[at], kth)

                raise_edge(np.flatnonzero(edge == -np.inf))
                i, d = np.divmod(np.flatnonzero(value >= edge[:, None]), size)
                raise_edge(np.flatnonzero(np.bincount(i, minlength=len(q)) > k))
                there = (value[i, d] >= edge[i]) & (value[i, d] > -np.inf)
                i, d = i[there], d[there]
                if not len(i):
                    continue
                if alpha == 0.0:
                    score = lex[q[i], d]
                elif alpha == 1.0:
                    score = exact(q[i], d)
                else:
                    at = q[i]
                    part = 0.0
                    if s is not None:
                        part = np.where(block.vectors.missing[d], 0.0,
                                        _norm(exact(at, d), scales.smin[lo + at], scales.smax[lo + at]))
                    score = alpha * part + (1.0 - alpha) * lnorm[at, d]
                best.offer(a * n + lo + q[i], topk.rounded(score), block.ids[d])
    return best


# ---------------------------------------------------------------- plans

def query_sets(weights: DataFrame | None, query_vecs: DataFrame | None, kind: str) -> Iterator[QuerySet]:
    """The queries in sets of bounded size; sets are cut by a hash of the query id."""
    column = vector_search.COLUMN[kind]
    rows, counts = [], [1]
    if weights is not None:
        n = weights.count()
        counts += [-(-n // lexical.QUERY_WEIGHTS)]
        rows.append(weights.select("query_id").distinct())
    if query_vecs is not None:
        size = F.size(F.col(column)) if kind == "dense" else F.aggregate(
            column, F.lit(0).cast("long"), lambda a, v: a + F.size(v))
        n, values = query_vecs.agg(F.count("*"), F.sum(F.greatest(size, F.lit(0)))).first()
        counts += [-(-n // QUERY_ROWS), -(-(values or 0) // QUERY_VALUES)]
        rows.append(query_vecs.select("query_id"))
    sets = max(counts)

    def part(df: DataFrame, i: int) -> pa.Table:
        return (df if sets == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i)).toArrow()

    for i in range(sets):
        words = part(weights, i) if weights is not None else None
        vecs = part(query_vecs.select("query_id", column), i) if query_vecs is not None else None
        ids = list(dict.fromkeys(x for t in (vecs, words) if t is not None for x in t.column("query_id").to_pylist()))
        number = {q: j for j, q in enumerate(ids)}
        made = None
        if vecs is not None:
            held = vecs.column(column).combine_chunks()
            if len(ids) > len(held):
                held = pa.concat_arrays([held, pa.nulls(len(ids) - len(held), held.type)])
            made = vector_search.KINDS[kind](held)
        yield QuerySet(ids, lexical.TermWeights(words, number) if words is not None else None, made, None, number)


def _run(source: Source, queries: QuerySet, lexical_side: bool, semantic_side: bool, schema: str, finish) -> DataFrame:
    sent = source.frame.sparkSession.sparkContext.broadcast(queries)
    blocks = source.blocks(semantic_side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        if q.ids:
            yield from finish(blocks(batches, q), q)

    return source.columns(lexical_side, semantic_side).mapInArrow(run, schema)


def extremes(source: Source, queries: QuerySet) -> DataFrame:
    """Per query: exact least and greatest vector score, and rounded BM25 score of matches."""
    found = _run(source, queries, queries.weights is not None, queries.vectors is not None, EXTREMES,
                 lambda blocks, q: [_extremes(blocks, q)])
    return found.groupBy("query_id").agg(F.min("smin").alias("smin"), F.max("smax").alias("smax"),
                                         F.min("lmin").alias("lmin"), F.max("lmax").alias("lmax"))


def best(source: Source, queries: QuerySet, alphas: Sequence[float], k: int, report: Report | None = None) -> DataFrame:
    """``(alpha, query_id, rank, doc_id, score)``: the top ``k`` per weight and query."""
    alphas = tuple(float(a) for a in alphas)
    lexical_side, semantic_side = min(alphas) < 1.0 and queries.weights is not None, max(alphas) > 0.0

    def finish(blocks: Iterator[Block], q: QuerySet) -> Iterator[pa.RecordBatch]:
        n = len(q.ids)
        rows = list(_best(blocks, q, alphas, k, report).rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([alphas[i // n] for i, _, _ in rows], pa.float64()), pa.array([q.ids[i % n] for i, _, _ in rows], pa.string()),
             pa.array([d for _, d, _ in rows], pa.string()), pa.array([s for _, _, s in rows], pa.float64())],
            names=["alpha", "query_id", "doc_id", "score"])

    found = _run(source, queries, lexical_side, semantic_side, TOPK, finish)
    return ranking.top_k(found, k, group_cols=("alpha", "query_id")).select("alpha", "query_id", "rank", "doc_id", "score")


def matches(source: Source, queries: QuerySet) -> DataFrame:
    """``(query_id, doc_id, score, norm)`` of every document with a query's term; ``scales`` must be known."""
    def finish(blocks: Iterator[Block], q: QuerySet) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            some = np.flatnonzero(block.bound(len(q.ids)) > 0)
            step = max(1, lexical.CELLS // max(len(block.ids), 1))
            for i in range(0, len(some), step):
                rows = some[i:i + step]
                raw = block.postings.scores(rows)
                at, d = np.nonzero(raw > 0)
                score = topk.rounded(raw[at, d])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(q.ids, object)[rows[at]], pa.string()), pa.array(block.ids[d], pa.string()),
                     pa.array(score), pa.array(_norm(score, q.scales.lmin[rows[at]], q.scales.lmax[rows[at]]))],
                    names=["query_id", "doc_id", "score", "norm"])

    return _run(source, queries, True, False, "query_id string, doc_id string, score double, norm double", finish)


def with_scales(source: Source, queries: QuerySet, cap: int | None = None) -> QuerySet:
    """The set with its scales, from one pass of extremes (and one of the top ``cap``, if given)."""
    n = len(queries.ids)
    out = Scales(*(np.full(n, np.nan) for _ in range(4)))
    for row in extremes(source, queries).toArrow().to_pylist():      # one row a query of a bounded set
        i = queries.number[row["query_id"]]
        out.smin[i], out.smax[i], out.lmin[i], out.lmax[i] = (
            np.nan if row[c] is None else row[c] for c in ("smin", "smax", "lmin", "lmax"))
    if cap is not None and queries.weights is not None:
        top = stored(best(source, queries, [0.0], cap), "candidates")
        ends = top.groupBy("query_id").agg(F.min("score").alias("lmin"), F.max_by("doc_id", "rank").alias("last"))
        out.last = [None] * n
        for row in ends.toArrow().to_pylist():
            i = queries.number[row["query_id"]]
            out.lmin[i], out.last[i] = row["lmin"], (row["lmin"], row["last"])
    queries.scales = out
    return queries
