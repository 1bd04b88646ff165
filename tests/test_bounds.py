"""Bounds on what a task holds, and sums over all rows."""

import numpy as np
import pyarrow as pa

from lumenrank import session
from lumenrank.operators import lexical, scan, vector_search


def test_blocks_are_bounded_by_words(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_WORDS", 1000)
    texts = pa.array([[f"w{j}" for j in range(i)] for i in (*range(300), 5000)])
    blocks = list(lexical._blocks_of([str(i) for i in range(301)], texts, None))
    assert sorted(int(n) for b in blocks for n in b["lens"]) == [*range(300), 5000]
    assert all(sum(b["lens"]) <= 1000 or len(b["ids"]) == 1 for b in blocks)
    assert max(len(b["ids"]) for b in blocks) <= lexical.BLOCK_DOCS


def test_blocks_are_written_and_read_in_small_parts(spark, monkeypatch):
    session.ship_package(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 128
    groups = []
    monkeypatch.setattr(lexical, "stored", lambda df, name, row_group=None: (
        groups.append(row_group), session.stored(df, name, row_group))[1])
    corpus = spark.range(100).selectExpr("cast(id as string) as id", "concat('a b', id) as text")
    assert lexical.build_index(corpus).n_docs == 100
    assert groups[0] is not None and groups[0] <= 16 << 20


def test_maxsim_by_position_adds_only_what_is_there():
    """Lists of unlike length, empty and null ones, repeated and negative vectors."""
    rng = np.random.default_rng(5)
    kind = pa.list_(pa.list_(pa.float64()))
    lists = [[rng.normal(size=4).tolist() for _ in range(n)] for n in (3, 0, 1, 7, 2)]
    lists.append([lists[0][0]] * 3)
    queries, docs = [lists[3], [], *lists], [*lists, None, lists[3]]
    got = vector_search.Multi(pa.array(queries, kind)).approximate(1, len(queries), vector_search.Multi(pa.array(docs, kind)))
    want = [[sum(max(np.dot(a, b) for b in d) for a in q) if q and d else 0.0 for d in docs] for q in queries[1:]]
    assert np.allclose(got, want, atol=1e-12)
    pairs = np.divmod(np.arange(got.size), got.shape[1])
    exact = vector_search.Multi(pa.array(queries[1:], kind)).exact(*pairs, vector_search.Multi(pa.array(docs, kind)))
    assert np.allclose(exact.reshape(got.shape), want, atol=1e-12)


def test_vector_ranking_looks_for_the_kth_of_a_block_only_while_lists_are_short(monkeypatch):
    rng = np.random.default_rng(3)
    rows, asked = rng.normal(size=(4096, 8)), []
    dense = lambda x: vector_search.Dense(pa.array(x.tolist(), pa.list_(pa.float64())))
    queries = scan.QuerySet([str(i) for i in range(50)], None, dense(rng.normal(size=(50, 8))))
    blocks = [scan.Block(np.array([str(i) for i in range(lo, lo + 512)], object), None, dense(rows[lo:lo + 512]))
              for lo in range(0, 4096, 512)]
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **kw: (asked.append(len(x)), partition(x, *a, **kw))[1])
    got = scan._best(iter(blocks), queries, [1.0], 5, None)
    scores = queries.vectors.rows @ rows.T
    for i in range(50):
        assert [int(d) for _, d in got.lists[i]] == np.argsort(-scores[i])[:5].tolist()
    assert sum(asked) < 150     # 50 queries in 8 blocks
