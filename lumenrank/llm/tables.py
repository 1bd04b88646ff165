"""Reading inputs by exact column name, and tables kept in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns named in ``wanted`` (new name: type), found by exact spelling.

    Other columns are dropped first, whatever their names, so that neither a second
    spelling (``TEXT``) nor a column named like one of ours can clash.  The first of
    several equal names counts; a missing one is an error.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [name for name in wanted if name not in at]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{at[name]}").cast(kind).alias(name) for name, kind in wanted.items()])


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of a table of documents."""
    return pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver's JVM ends."""
    folder = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


BROADCAST_IDS = 2_000_000   # 16 MB of ids


def sent_if_small(ids: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids with a broadcast hint if it is proven to have at most ``rows`` rows, else as it is."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


_scopes: list[list[str]] = []   # folders kept inside the open scopes, innermost last


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, outlives executors."""
    folder = shared_folder(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(folder)
    return _written(df, folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables kept inside are removed at the end, so everything read later must be written inside.

    Gives the function that does so: ``keep`` for a table that belongs to the scope around
    this one.  Shuffle files of a job inside are removed when the job has ended, not when the
    driver next collects garbage: its result is a written table, which no shuffle has to make again.
    """
    def save(df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(spark, name)
        if len(_scopes) > 1:
            _scopes[-2].append(folder)
        return _written(df, folder)

    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    _scopes.append([])
    try:
        yield save
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
