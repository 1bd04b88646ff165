"""Top-k per query with a deterministic tie rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, group_cols: tuple[str, ...] = ("query_id",),
          score_col: str = "score", tie_col: str = "doc_id") -> DataFrame:
    """Keep the ``k`` best rows per group, adding a 1-based ``rank``.

    Order: score descending, then ``tie_col`` ascending.  Spark plans the
    ``row_number() <= k`` filter as a partial ``WindowGroupLimit`` before the
    shuffle, so each map task sends at most ``k`` rows per group: a query that
    matches a third of the corpus does not pile its candidates into one task.
    """
    if k < 1:
        raise ValueError("k must be a positive integer")
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), F.col(tie_col).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cut(ranking: DataFrame, k: int) -> DataFrame:
    """One ranking retrieved at max K serves every smaller cutoff."""
    return ranking.where(F.col("rank") <= k)
