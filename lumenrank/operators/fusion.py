"""Dense, late-interaction and hybrid rankings.

``alpha`` dispatch (one plan for a whole alpha grid):

* alpha = 1: raw semantic score, no lexical side.
* alpha = 0: BM25 limited to ``max_k`` (only documents with a lexical match).
* 0 < alpha < 1: lexical candidates = BM25 top ``cap`` (``min(cap, corpus)``,
  ``None`` = whole corpus); both sides min-max normalised per query (semantic
  over the whole corpus, lexical over the candidates); fused =
  ``alpha*sem + (1-alpha)*lex`` with the missing side 0; top ``max_k``.

A document's postings and vectors lie in one block (``lexical.build_index`` with vectors),
so fusion happens where the block is: a first pass finds both sides' extremes per query
(one partial row per task), a second ranks every weight of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.operators import lexical, scan, vector_search

DEFAULT_ALPHAS = (0.25, 0.5, 0.75, 1.0)


def minmax_normalise(scores: DataFrame, score_col: str = "score",
                     out_col: str = "norm", group: str = "query_id") -> DataFrame:
    """Per group (x-min)/(max-min); a constant group maps to 1.0."""
    mm = scores.groupBy(group).agg(F.min(score_col).alias("_mn"), F.max(score_col).alias("_mx"))
    return (scores.join(mm, group)
            .withColumn(out_col, _norm(F.col(score_col), F.col("_mn"), F.col("_mx")))
            .drop("_mn", "_mx"))


def _norm(x: Column, mn: Column, mx: Column) -> Column:
    return F.when(mx == mn, F.lit(1.0)).otherwise((x - mn) / (mx - mn))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def semantic_ranking(doc_vecs: DataFrame, query_vecs: DataFrame, k: int, kind: str = "dense") -> DataFrame:
    """R4 / R6 at alpha 1: ``(query_id, rank, doc_id, score)`` by the raw semantic score (rounded)."""
    source = scan.Source(doc_vecs=doc_vecs, kind=kind)
    return _union([scan.best(source, q, [1.0], k) for q in scan.query_sets(None, query_vecs, kind)]).drop("alpha")


def lexical_ranking(index: lexical.LexicalIndex, queries: DataFrame, k: int,
                    report: scan.Report | None = None) -> DataFrame:
    """R2 + R9: ``(query_id, rank, doc_id, score)``, the BM25 top ``k`` per query."""
    source = scan.Source(index)
    weights = lexical.query_weights(index, queries)
    return _union([scan.best(source, q, [0.0], k, report) for q in scan.query_sets(weights, None, "dense")]).drop("alpha")


def lexical_matches(index: lexical.LexicalIndex, queries: DataFrame) -> DataFrame:
    """R2 + R7 without a limit: ``(query_id, doc_id, score, norm)`` of every match."""
    source = scan.Source(index)
    weights = lexical.query_weights(index, queries)
    return _union([scan.matches(source, scan.with_scales(source, q)) for q in scan.query_sets(weights, None, "dense")])


def hybrid_ranking(index: lexical.LexicalIndex, queries: DataFrame, query_vecs: DataFrame,
                   alphas: Sequence[float] = DEFAULT_ALPHAS, max_k: int = 10, cap: int | None = None,
                   kind: str = "dense", report: scan.Report | None = None) -> DataFrame:
    """R5/R10 for a whole alpha grid: ``(alpha, query_id, rank, doc_id, score)``; ``index`` holds the vectors."""
    alphas = [float(a) for a in alphas]
    for a in alphas:
        if not 0.0 <= a <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
    if cap is not None and cap < 1:
        raise ValueError("cap must be a positive integer")
    source = scan.Source(index, kind=kind)
    weights = lexical.query_weights(index, queries)
    mixed = any(0.0 < a < 1.0 for a in alphas)
    parts = []
    for q in scan.query_sets(weights, query_vecs, kind):
        if mixed:
            q = scan.with_scales(source, q, None if cap is None else min(cap, max(index.n_docs, 1)))
        parts.append(scan.best(source, q, alphas, max_k, report))
    return _union(parts)


def exact_scores(pairs: DataFrame, doc_vecs: DataFrame, query_vecs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, sem)``: sequential double dot product of given pairs, in the JVM."""
    j = (pairs.join(query_vecs.select("query_id", F.col("vector").alias("qv")), "query_id")
         .join(doc_vecs.select("doc_id", F.col("vector").alias("dv")), "doc_id"))
    return j.select("query_id", "doc_id", vector_search.dot("qv", "dv").alias("sem"))
