"""Evaluation runs: retrieve once at max K, score every cutoff in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators import fusion, lexical, metrics
from lumenrank.sources.io import RetrievalSet

BM25_LABEL = "BM25"


def bm25_ranking(rs: RetrievalSet, k: int, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """R2 + R9: ``(query_id, rank, doc_id, score)`` for the top ``k`` per query."""
    index = index or lexical.build_index(rs.corpus)
    return fusion.lexical_ranking(index, rs.queries, k)


def bm25_baseline(rs: RetrievalSet, cutoffs=metrics.DEFAULT_CUTOFFS,
                  index: lexical.LexicalIndex | None = None) -> DataFrame:
    """The lexical baseline row (alpha 0, no embedding cost)."""
    n_queries = rs.queries.count()
    n_docs = index.n_docs if index is not None else rs.corpus.count()
    ranked = bm25_ranking(rs, metrics.max_k(cutoffs), index)
    m = metrics.compute_metrics(ranked, rs.qrels, n_queries, cutoffs)
    return m.select(F.lit(BM25_LABEL).alias("model"), F.lit(0.0).alias("alpha"), "*",
                    F.lit(n_queries).cast("long").alias("num_queries"),
                    F.lit(n_docs).cast("long").alias("num_documents"))
