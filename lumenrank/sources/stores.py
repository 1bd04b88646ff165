"""Vector and evaluation-result stores on Parquet.

Stores are directories partitioned by key (``cache_key`` / ``eval_key``), so
existence and loads prune to one partition; a write replaces its own keys only.
Vectors of a run that may fail go through :class:`VectorStore` (S11).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.sources import sinks


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_keyed(df: DataFrame, root: str, key_col: str, key: str) -> None:
    """Write ``df`` under ``root/{key_col}={key}``, replacing only that key."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (df.withColumn(key_col, F.lit(key)).write.mode("overwrite")
         .partitionBy(key_col).parquet(root))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def exists(spark: SparkSession, root: str, key_col: str, key: str) -> bool:
    return _path_exists(spark, f"{root}/{key_col}={key}")


def load_keyed(spark: SparkSession, root: str, key_col: str, key: str) -> DataFrame:
    """Load one key; a missing key is an error."""
    if not exists(spark, root, key_col, key):
        raise FileNotFoundError(f"no entry {key!r} in {root}")
    return spark.read.parquet(f"{root}/{key_col}={key}")  # the path itself: keys are never read as numbers


# Vectors (``doc_id, vector`` or ``doc_id, vectors``) plus metadata row
def save_vectors(vectors: DataFrame, root: str, cache_key: str, metadata: dict | None = None) -> None:
    save_keyed(vectors, f"{root}/vectors", "cache_key", cache_key)
    meta = vectors.sparkSession.createDataFrame(
        [(k, str(v)) for k, v in (metadata or {}).items()] or [("", "")], "name string, value string")
    save_keyed(meta.where(F.col("name") != ""), f"{root}/metadata", "cache_key", cache_key)


def load_vectors(spark: SparkSession, root: str, cache_key: str) -> DataFrame:
    return load_keyed(spark, f"{root}/vectors", "cache_key", cache_key)


def load_metadata(spark: SparkSession, root: str, cache_key: str) -> dict:
    """Missing metadata -> empty dict."""
    if not exists(spark, f"{root}/metadata", "cache_key", cache_key):
        return {}
    return {r.name: r.value for r in load_keyed(spark, f"{root}/metadata", "cache_key", cache_key).collect()}


# Evaluation results, one partition per eval key
def save_results(results: DataFrame, root: str) -> None:
    """Append/replace result rows that carry an ``eval_key`` column."""
    spark = results.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        results.write.mode("overwrite").partitionBy("eval_key").parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def pending(grid: DataFrame, root: str) -> DataFrame:
    """Grid rows whose ``eval_key`` is not stored yet."""
    spark = grid.sparkSession
    if not _path_exists(spark, root):
        return grid
    stored = spark.read.parquet(root).select("eval_key").distinct()
    return grid.join(stored, "eval_key", "left_anti")


def load_results(spark: SparkSession, root: str, grid: DataFrame) -> DataFrame:
    """Stored result rows of the ``eval_key`` values in ``grid``; nothing stored gives no rows."""
    if not _path_exists(spark, root):
        return grid.limit(0)
    return spark.read.parquet(root).join(grid.select("eval_key").distinct(), "eval_key", "left_semi")


def reuse_results(spark: SparkSession, root: str, grid: DataFrame, label: str = "model_short") -> DataFrame:
    """Stored rows of the grid under the grid's display labels, which are stored again where they changed.

    ``grid(eval_key, label)`` has one row per key.  The merge goes by key: partitions whose
    label is the same are not written.
    """
    named = grid.select("eval_key", F.col(label).alias("_label"))
    rows = load_results(spark, root, grid).join(named, "eval_key")
    changed = rows.where(~F.col(label).eqNullSafe(F.col("_label")))
    keys = changed.select("eval_key").distinct()
    fresh = rows.join(keys, "eval_key", "left_semi").withColumn(label, F.col("_label")).drop("_label")
    if not keys.isEmpty():
        from lumenrank.session import stored

        save_results(stored(fresh, "relabelled"), root)     # the rows read are the ones replaced: copied first
    return load_results(spark, root, grid)


# Deferred commit
class VectorStore:
    """Vectors by key in versions; one pointer file says which version of each key counts.

    ``stage`` writes a new version that no reader sees.  ``commit`` replaces the pointer in
    one atomic rename, for all staged keys together, so a run that ends before it, at any
    place, leaves the former versions readable; ``discard`` drops what was staged.  One
    writer at a time; readers need no lock.
    """

    POINTER = "CURRENT.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.staged: dict[str, str] = {}

    def current(self) -> dict[str, str]:
        """Version folder of each key."""
        text = sinks.read_text(self.spark, f"{self.root}/{self.POINTER}")
        return json.loads(text) if text else {}

    def stage(self, vectors: DataFrame, key: str, metadata: dict | None = None) -> DataFrame:
        """Write a version of ``key`` and read it back, not yet visible to others."""
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        vectors.write.parquet(f"{folder}/vectors")
        sinks.write_text(self.spark, f"{folder}/metadata.json", json.dumps(metadata or {}, sort_keys=True))
        if key in self.staged:
            self._drop(self.staged[key])
        self.staged[key] = folder
        return self.spark.read.schema(vectors.schema).parquet(f"{folder}/vectors")

    def commit(self) -> None:
        """Make every staged version the current one of its key."""
        before = self.current()
        sinks.write_text(self.spark, f"{self.root}/{self.POINTER}", json.dumps({**before, **self.staged}, sort_keys=True))
        for key in self.staged:
            if key in before and before[key] != self.staged[key]:
                self._drop(before[key])
        self.staged = {}

    def discard(self) -> None:
        """Drop every staged version; current ones stay as they are."""
        for folder in self.staged.values():
            self._drop(folder)
        self.staged = {}

    def exists(self, key: str) -> bool:
        return key in self.current()

    def load(self, key: str) -> DataFrame:
        """The current version; a missing key is an error."""
        return self.spark.read.parquet(f"{self._folder(key)}/vectors")

    def metadata(self, key: str) -> dict:
        return json.loads(sinks.read_text(self.spark, f"{self._folder(key)}/metadata.json") or "{}")

    def _folder(self, key: str) -> str:
        current = self.current()
        if key not in current:
            raise FileNotFoundError(f"no entry {key!r} in {self.root}")
        return current[key]

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
