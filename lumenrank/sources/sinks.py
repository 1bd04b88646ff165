"""Ordered single-file exports.

Rows are brought into order by a range exchange and written as part files; the parts are
then joined, in their order, by the Hadoop file system of the target.  No rows are collected.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place, then renamed over it."""
    fs, draft = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    rename = spark.sparkContext._gateway.new_array(options, 1)
    rename[0] = options.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path)), rename)


def read_text(spark, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, where = _hadoop(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_lines(lines: DataFrame, path: str, order: Sequence[str], header: str | None = None) -> None:
    """One file of ``lines(line, ...)`` in the order of the columns ``order``."""
    spark = lines.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    lines.orderBy(*order).select("line").write.text(folder)
    fs, where = _hadoop(spark, folder)
    _, draft = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    if header is not None:
        out.write(bytearray((header + "\n").encode("utf-8")))
    parts = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    for part in parts:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(part))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
        stream.close()
    out.close()
    fs.delete(where, True)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} cannot be written")


def csv_line(columns: Sequence[Column]) -> Column:
    """A CSV line: quotes where a value has a comma, quote or line end; null is empty."""
    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(x in name for x in '",\r\n') else name


def first_seen_keys(rows: DataFrame, order: Sequence[str], values: str = "values") -> list[str]:
    """Keys of the map column ``values``, by the first row and place in it that has them.

    What comes to the driver is one row per key, that is, per column of the export.
    """
    keys = rows.select(F.struct(*order).alias("_at"), F.posexplode(F.map_keys(values)).alias("_place", "_key"))
    return [r._key for r in keys.groupBy("_key").agg(F.min(F.struct("_at", "_place")).alias("_first"))
            .orderBy("_first").collect()]


def write_results_csv(rows: DataFrame, path: str, order: Sequence[str], values: str = "values") -> list[str]:
    """Result rows (a map of values each) as CSV; columns as first seen, gaps empty.  Returns the columns."""
    names = first_seen_keys(rows, order, values)
    line = csv_line([F.try_element_at(values, F.lit(n)) for n in names]) if names else F.lit("")
    write_lines(rows.select(*order, line.alias("line")), path, order, ",".join(map(_quoted, names)))
    return names


CATALOG = ("dataset_path", "dataset_revision", "tasks")


def write_catalog(catalog: DataFrame, path: str, kind: str) -> bool:
    """The deduplicated catalog as ``json`` (a line a record), ``csv`` or ``text`` (tabs).

    Tasks are joined with ``;`` in CSV and ``, `` in text.  An empty catalog gives an empty
    file without a header; whether there were rows is returned.
    """
    order = ["dataset_path", "dataset_revision"]
    some = not catalog.isEmpty()
    if kind == "json":
        lines = catalog.select(*order, F.to_json(F.struct(*CATALOG)).alias("line"))
        write_lines(lines, path, order)
    elif kind == "csv":
        line = csv_line([F.col(order[0]), F.col(order[1]), F.concat_ws(";", "tasks")])
        write_lines(catalog.select(*order, line.alias("line")), path, order, ",".join(CATALOG) if some else None)
    elif kind == "text":
        line = F.concat_ws("\t", F.col(order[0]), F.col(order[1]), F.concat_ws(", ", "tasks"))
        write_lines(catalog.select(*order, line.alias("line")), path, order)
    else:
        raise ValueError(f"no export of kind {kind}")
    return some


def write_manifest(stats: DataFrame, path: str, about: dict, schema_version: int = 1) -> None:
    """The one row of ``stats`` and a description as nested JSON with sorted keys."""
    row = stats.limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"a manifest describes one sample, not {len(row)}")
    simple = (T.NumericType, T.StringType, T.BooleanType)
    if not all(isinstance(f.dataType, simple) for f in stats.schema):
        raise ValueError("statistics are numbers, texts or truth values")
    content = {**about, "schema_version": schema_version, "sampling": row[0].asDict()}
    write_text(stats.sparkSession, path, json.dumps(content, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
