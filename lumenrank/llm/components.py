"""Connected components of links between numbered nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def _roots(links: DataFrame) -> DataFrame:
    """id, root: each node's smallest neighbour, followed until it is its own smallest."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    up = keep(both.groupBy("id").agg(F.min("other").alias("other"))
              .select("id", F.least("id", "other").alias("root")), "parents")
    while True:
        above = up.select(F.col("id").alias("_at"), F.col("root").alias("_next"))
        moved = up.join(above, F.col("root") == F.col("_at")).where(F.col("_next") != F.col("root"))
        if moved.isEmpty():
            return up
        up = keep(up.join(above, F.col("root") == F.col("_at"))
                  .select("id", F.col("_next").alias("root")), "parents")  # half the way each time


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every node in ``links`` (a, b), a kept table.

    Each round joins every node with its smallest neighbour's tree, names the trees by
    their roots and keeps the links between different ones; trees at least halve.
    """
    links = links.where("a <> b")
    labels = None
    while not links.isEmpty():
        roots = _roots(links)
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            step = roots.withColumnRenamed("id", "_at")
            labels = keep(labels.join(step, F.col("label") == F.col("_at"), "left")
                          .select("id", F.coalesce("root", "label").alias("label")), "labels")
        first = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        second = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        links = keep(links.join(first, "a").join(second, "b").where("ra <> rb")
                     .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
