"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared checkpoint folder and reads it again for the next one.  All stages
but the last keep the columns of ``documents``, whatever else they are called.  Stages that
remove documents decide row by row: rows that share an id, or have none, are told apart by
a number, so one row of a group of copies stays, and a clean row never goes with another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import decontaminate, near_duplicates, packing, quality, secrets
from lumenrank.llm.tables import keep, read, sent_if_small
from lumenrank.session import ship_package


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _same_columns(stage: Stage) -> Stage:
    """A stage that sees other columns than doc_id, text and n_chars under names that clash with nothing."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        first = {name: i for i, name in reversed(list(enumerate(docs.columns)))}
        names = [c if c in ("doc_id", "text", "n_chars") and first[c] == i else f"_other{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, kept so that every reader sees the same numbers."""
    return keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows without those whose numbers are the ``doc_id`` of ``gone``."""
    numbers = keep(gone.select(F.col("doc_id").alias("_row")), "gone")
    return docs.join(sent_if_small(numbers), "_row", "left_anti")


@_same_columns
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier does not reject by its quantile cut; it learns from ``docs`` and ``labels``."""
    ranker = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.add_scores(docs, ranker).where(F.col("_raw") >= ranker.cut)


@_same_columns
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    rows = _numbered(docs)
    found = near_duplicates.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    return _without(rows, found.where(~F.col("kept")))


@_same_columns
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by benchmark items."""
    rows = _numbered(docs)
    found = decontaminate.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(rows, found.where("contaminated"))


@_same_columns
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage),
          ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

# Trained scores, MinHash and a tokenizer are beyond SQL; see tests/llm/test_edges.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
