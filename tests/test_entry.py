import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["mrr@10"] <= 1.0


def test_every_query_has_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(n(x) for x in v)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", ["bm25_metrics", "dense_metrics", "hybrid_alpha_metrics",
                                 "late_hybrid_metrics", "dataset_violations", "pareto_flags",
                                 "sample_stats", "catalog_best_version"])
def test_against_duckdb_small(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    rel = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(rel.fetchall(), ocols)
