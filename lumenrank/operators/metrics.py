"""Ranking quality metrics as one aggregation.

The first relevant rank of a query answers every cutoff at once
(``rr@k = 1/r if r <= k``, ``hit@k = r <= k``), so a whole grid of runs and
cutoffs is one ``groupBy(run)`` over ``(run, query, first_rel_rank)``.
Queries without any relevant hit contribute zero: means divide by the number
of queries, never by the number of rows that joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default cutoffs of the evaluation configuration.
DEFAULT_CUTOFFS = {"mrr": [1, 3, 10], "hit_rate": [3]}
METRICS = ("mrr", "hit_rate")


def validate_cutoffs(cutoffs: object) -> dict[str, list[int]]:
    """A mapping of both metrics to lists of whole cutoffs from 1 on, at least one each."""
    if not isinstance(cutoffs, dict):
        raise TypeError(f"cutoffs are a mapping of metric to list, not {type(cutoffs).__name__}")
    problems = [f"{name}: unknown or missing" for name in set(map(str, cutoffs)) ^ set(METRICS)]
    for name, ks in cutoffs.items():
        whole = isinstance(ks, list) and all(type(k) is int for k in ks)
        if not whole or not ks or min(ks) < 1:
            problems.append(f"{name}: {ks!r} is no list of whole numbers from 1 on")
    if problems:
        raise ValueError("bad cutoffs; " + "; ".join(sorted(problems)))
    return cutoffs


def resolve_cutoffs(mrr_k: list[int] | None = None, hit_rate_k: list[int] | None = None,
                    top_k: int | list[int] | None = None) -> dict[str, list[int]]:
    """M6: per-metric lists, else the legacy ``top_k`` (int or list), else ``[10]``."""
    legacy = [10] if top_k is None else ([top_k] if isinstance(top_k, int) and not isinstance(top_k, bool) else top_k)
    return validate_cutoffs({"mrr": mrr_k if mrr_k is not None else legacy,
                             "hit_rate": hit_rate_k if hit_rate_k is not None else legacy})


def max_k(cutoffs: dict[str, list[int]]) -> int:
    validate_cutoffs(cutoffs)
    return max(k for ks in cutoffs.values() for k in ks)


def metric_name(metric: str, k: int) -> str:
    """``('mrr', 10)`` -> ``'mrr@10'``."""
    return f"{metric}@{k}"


def parse_metric_name(name: str) -> tuple[str, int]:
    """X10 inverse: ``'mrr@10'`` -> ``('mrr', 10)``."""
    metric, _, k = name.partition("@")
    return metric, int(k)


def positives(qrels: DataFrame) -> DataFrame:
    """Relevant pairs ``(query_id, doc_id)``: score > 0, duplicates collapsed."""
    return (qrels.where(F.col("score") > 0)
            .select("query_id", F.col("corpus_id").alias("doc_id")).distinct())


def relevance_lists(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row per query with the sorted list of its relevant documents."""
    pos = positives(qrels)
    return (queries.select(F.col("id").alias("query_id"), F.col("text").alias("query"))
            .join(pos, "query_id", "left")
            .groupBy("query_id", "query")
            .agg(F.array_sort(F.collect_set("doc_id")).alias("relevant_ids")))


def first_relevant(ranking: DataFrame, qrels: DataFrame,
                   run_cols: Sequence[str] = ()) -> DataFrame:
    """J2 + M1 core: ``(run..., query_id, first_rel_rank)`` for queries with a hit."""
    return (ranking.join(positives(qrels), ["query_id", "doc_id"])
            .groupBy(*run_cols, "query_id")
            .agg(F.min("rank").alias("first_rel_rank")))


def _metric_columns(cutoffs: dict[str, list[int]], r: str = "first_rel_rank"):
    cols = []
    for k in cutoffs["mrr"]:
        cols.append((metric_name("mrr", k),
                     F.when(F.col(r) <= k, F.lit(1.0) / F.col(r)).otherwise(F.lit(0.0))))
    for k in cutoffs["hit_rate"]:
        cols.append((metric_name("hit_rate", k),
                     F.when(F.col(r) <= k, F.lit(1.0)).otherwise(F.lit(0.0))))
    return cols


def per_query(ranking: DataFrame, qrels: DataFrame, queries: DataFrame,
              cutoffs: dict[str, list[int]] = DEFAULT_CUTOFFS) -> DataFrame:
    """M1/M2 per query for one run: every query appears, misses score 0."""
    validate_cutoffs(cutoffs)
    fr = first_relevant(ranking, qrels)
    base = queries.select(F.col("id").alias("query_id")).join(fr, "query_id", "left")
    return base.select("query_id", "first_rel_rank",
                       *[c.alias(n) for n, c in _metric_columns(cutoffs)])


def compute_metrics(ranking: DataFrame, qrels: DataFrame, n_queries: int,
                    cutoffs: dict[str, list[int]] = DEFAULT_CUTOFFS,
                    runs: DataFrame | None = None,
                    run_cols: Sequence[str] = ()) -> DataFrame:
    """M3-M5 for every run in one pass.

    ``ranking`` holds ``(run_cols..., query_id, rank, doc_id)`` cut at max K.
    ``runs`` lists every run so that a run without a single hit still gets a
    row of zeros.  Raises on an empty query set (the mean is undefined).
    """
    validate_cutoffs(cutoffs)
    if n_queries <= 0:
        raise ValueError("metrics of no queries are undefined")
    fr = first_relevant(ranking, qrels, run_cols)
    cols = _metric_columns(cutoffs)
    sums = fr.groupBy(*run_cols).agg(*[F.sum(c).alias(n) for n, c in cols])
    if run_cols and runs is not None:
        sums = runs.join(sums, list(run_cols), "left")
    elif not run_cols:
        # a run without hits yields no row from the aggregation over zero rows
        # only when grouped; the global agg always yields one row.
        pass
    return sums.select(*run_cols, *[
        (F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) / F.lit(float(n_queries))).alias(n)
        for n, _ in cols])
