"""Named query keys: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Column names and types match the DuckDB oracles in ``oracles.py``; metric
values are rounded to 6 decimals, scores to 9.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import lexical, metrics
from lumenrank.plans import evaluation, fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        _REGISTRY[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # import modules that register further keys
    from lumenrank.plans import registry_more  # noqa: F401
    return dict(_REGISTRY)


def round_metrics(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


METRIC_COLS = ["mrr@1", "mrr@3", "mrr@10", "hit_rate@3"]


@register("term_statistics")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every term of the corpus."""
    rs = fixtures.known_set(spark, sf_dir)
    idx = lexical.build_index(rs.corpus)
    return idx.terms.select("term", F.col("df").cast("long").alias("df"),
                            F.round("idf", 9).alias("idf"))


@register("bm25_topk")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + R9 + K1: BM25 top 10 per query."""
    rs = fixtures.known_set(spark, sf_dir)
    return evaluation.bm25_ranking(rs, 10).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register("bm25_metrics")
def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M5 + R13: MRR@1/3/10 and Hit Rate@3 of the lexical baseline."""
    rs = fixtures.known_set(spark, sf_dir)
    return round_metrics(evaluation.bm25_baseline(rs), METRIC_COLS)


@register("rr_hit_per_query")
def rr_hit_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2: reciprocal rank and hit per query (all queries, misses = 0)."""
    rs = fixtures.known_set(spark, sf_dir)
    ranked = evaluation.bm25_ranking(rs, 10)
    pq = metrics.per_query(ranked, rs.qrels, rs.queries)
    return round_metrics(pq.withColumn("first_rel_rank", F.col("first_rel_rank").cast("long")),
                         METRIC_COLS)


@register("relevance_lists")
def relevance_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query view with the sorted list of relevant documents."""
    rs = fixtures.known_set(spark, sf_dir)
    return metrics.relevance_lists(rs.queries, rs.qrels)
