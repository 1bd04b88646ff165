"""Table loading and saving, and the retrieval-set container.

Qrels columns are ``query-id``/``corpus-id`` on disk (hyphens need back-ticks
in Spark SQL) and ``query_id``/``corpus_id`` inside the engine; the rename is
applied on read and undone on write.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARQUET_SUFFIXES = (".parquet", ".pq", ".parq")
DOCUMENT_PARQUET_SUFFIXES = (".parquet", ".pq")


@dataclass
class RetrievalSet:
    """corpus ``(id, text[, title])``, queries ``(id, text)``,
    qrels ``(query_id, corpus_id, score)``."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the lower-cased suffix (CSV or Parquet)."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (".csv",) + PARQUET_SUFFIXES:
        raise ValueError(f"Unsupported file format: {suffix or path}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if suffix == ".csv":
        return (spark.read.option("header", True).option("multiLine", True)
                .option("escape", '"').csv(path))
    return spark.read.parquet(path)


def _qrels_internal(qrels: DataFrame) -> DataFrame:
    if "query-id" in qrels.columns:
        qrels = qrels.withColumnRenamed("query-id", "query_id")
    if "corpus-id" in qrels.columns:
        qrels = qrels.withColumnRenamed("corpus-id", "corpus_id")
    return qrels


def load_retrieval_set(spark: SparkSession, directory: str,
                       corpus_file: str = "corpus.parquet",
                       queries_file: str = "queries.parquet",
                       qrels_file: str = "qrels.parquet",
                       validate: bool = True) -> RetrievalSet:
    """Three reads plus the V-rules (raising wrapper)."""
    from lumenrank.operators import validate as V

    corpus = load_data(spark, f"{directory}/{corpus_file}")
    queries = load_data(spark, f"{directory}/{queries_file}")
    qrels = _qrels_internal(load_data(spark, f"{directory}/{qrels_file}"))
    rs = RetrievalSet(corpus, queries, qrels)
    return V.validated(rs) if validate else rs


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``(id, text)``; ids ``doc_0…`` in the order of files and their rows when there is no ``id``."""
    from lumenrank.operators.ids import ids_in_file_order

    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (".csv",) + DOCUMENT_PARQUET_SUFFIXES:
        raise ValueError(f"Unsupported file format: {suffix or path}")
    df = load_data(spark, path)
    if "text" not in df.columns:
        raise ValueError("documents need a 'text' column")
    if "id" not in df.columns:
        df = ids_in_file_order(df, ["text"], "id", prefix="doc_")
    return df.select(F.col("id").cast("string").alias("id"), "text")


def save_retrieval_set(rs: RetrievalSet, directory: str) -> None:
    """Three Parquet files, qrels with their on-disk column names."""
    rs.corpus.write.mode("overwrite").parquet(f"{directory}/corpus.parquet")
    rs.queries.write.mode("overwrite").parquet(f"{directory}/queries.parquet")
    (rs.qrels.withColumnRenamed("query_id", "query-id")
     .withColumnRenamed("corpus_id", "corpus-id")
     .write.mode("overwrite").parquet(f"{directory}/qrels.parquet"))
