"""Dense sequential ids (``doc_0``, ``doc_1`` …) without a global window.

Rows are range-partitioned on the order key, numbered inside each partition,
and shifted by the row counts of the preceding partitions (a table with one
row per partition).  No task ever sees more than its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.session import bounded_broadcast, cut_lineage


def dense_ids(df: DataFrame, out_col: str, order_cols: list[str] | None = None,
              prefix: str = "", n_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order, as ``prefix + i``.

    Without ``order_cols`` the input order of the files is used (partition
    index, then position inside the partition), like a positional id.
    """
    if order_cols:
        ranged = df.repartitionByRange(n_partitions, *order_cols) if n_partitions else df.repartitionByRange(*order_cols)
        x = ranged.sortWithinPartitions(*order_cols)
    else:
        x = df
    # materialise once: the counts job and the numbering must see the same
    # partition contents (a re-run could draw other range bounds)
    x = cut_lineage(x.withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id()))
    counts = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: always small enough to broadcast
    x = x.join(F.broadcast(offsets.select("_p", "_off", "_first")), "_p")
    pos = F.col("_off") + (F.col("_i") - F.col("_first"))
    return (x.withColumn(out_col, F.concat(F.lit(prefix), pos.cast("string")) if prefix else pos)
            .drop("_p", "_i", "_off", "_first"))


def ids_in_file_order(table: DataFrame, columns: list[str], out_col: str, prefix: str = "") -> DataFrame:
    """``columns`` of a table read from files, with 0-based positions in the order of file names and rows.

    Spark deals files to partitions by size, so the partition index says nothing of their
    order.  A block of a file is read by one task from front to back: a row's place is its
    place in the block plus the rows of the blocks before it (a row per block).
    """
    rows = cut_lineage(table.select(*columns, F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
                                    F.monotonically_increasing_id().alias("_i")))
    blocks = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rows = rows.join(bounded_broadcast(offsets), "_block")
    pos = F.col("_off") + (F.col("_i") - F.col("_first"))
    return rows.select(*columns, (F.concat(F.lit(prefix), pos.cast("string")) if prefix else pos).alias(out_col))
