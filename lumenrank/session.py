"""Session construction and cluster-safe helpers (checkpoint dir, bounded broadcast)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sides we are willing to broadcast explicitly; anything above goes through a
# shuffle join (AQE may still demote it to a broadcast at run time using the
# measured size of the shuffle stage).
DEFAULT_BROADCAST_ROWS = 2_000_000

# A batch that goes to a Python worker is held by the JVM and by the worker, once
# per running task; the default of 64 MB of wide rows is too much for small executors.
ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = "4m"

# The Parquet reader decodes this many rows at once, whatever their size; the default of
# 4096 index blocks with their arrays is more than an executor has.
READ_ROWS_KEY = "spark.sql.parquet.columnarReaderBatchSize"
READ_ROWS = "128"


def get_spark(master: str | None = None, app: str = "lumenrank",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Create or reuse a session with AQE, skew-join handling and Arrow on.

    The number of shuffle partitions is set only if it is given: it belongs to the size of
    the data, not to the driver's machine, and AQE merges small partitions but splits none.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no broadcast from static (pre-run) size estimates: they undercount
        # exploded rows.  AQE still broadcasts a side whose *measured* shuffle
        # output is small, and explicit hints are placed only behind a count.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # text rows explode ~10x into tokens: keep scan splits modest so a
        # task's exploded rows stay small and every core gets work.
        .config("spark.sql.files.maxPartitionBytes", "32MB")
        .config("spark.sql.files.openCostInBytes", "1MB")
        .config("spark.driver.memory", os.environ.get("LUMENRANK_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name shared storage and is read as is.  Only
    a local-mode session without it (tests, the bench) gets a private folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
    path = tempfile.mkdtemp(prefix="lumenrank-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write a table to a new folder of the shared checkpoint folder and read it back.

    Cuts the lineage and outlives executors, and later reads take only the columns they
    need.  The folder goes when the driver's JVM ends.  ``row_group`` bounds the bytes that
    a task holds before it writes them, and so the smallest part that a reader can take.
    """
    import uuid

    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    (df.write if row_group is None else df.write.option("parquet.block.size", str(row_group))).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven below ``max_rows``.

    The count is a cheap job on the small side; when the bound fails the frame
    is returned unhinted and the planner uses a shuffle join instead.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Make ``lumenrank`` importable on executors (``addPyFile`` of a zip).

    Python workers import the functions used inside ``mapInPandas`` by module
    name; on a cluster (or from another working directory) the package must
    travel with the job.  Done once per SparkContext.  Also bounds the bytes of
    Arrow batches and the rows of Parquet batches, unless the session's builder set
    those bounds itself.
    """
    import zipfile

    sc = spark.sparkContext
    if not sc.getConf().contains(ARROW_BYTES_KEY):
        spark.conf.set(ARROW_BYTES_KEY, ARROW_BYTES)
    if not sc.getConf().contains(READ_ROWS_KEY):
        spark.conf.set(READ_ROWS_KEY, READ_ROWS)
    if getattr(sc, "_lumenrank_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lumenrank-pkg-"), "lumenrank.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._lumenrank_shipped = True
