"""Late interaction over vectors of one magnitude: signs instead of products, packed values, groups of blocks."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import embed, fusion, lexical, scan, vector_search

LISTS = pa.list_(pa.list_(pa.float32()))


def sign_lists(rng, sizes, width, magnitude=0.25):
    return [None if n is None else np.where(rng.random((n, width)) < 0.5, magnitude, -magnitude).astype(np.float32) for n in sizes]


def as_lists(lists):
    return pa.array([None if x is None else x.tolist() for x in lists], LISTS)


def packed(lists):
    return pa.array([None if x is None else vector_search.pack(x) for x in lists], pa.binary())


def maxsim(q, d):
    return sum(max(float(np.dot(a.astype(float), b.astype(float))) for b in d) for a in q) if len(q) and d is not None and len(d) else 0.0


@pytest.mark.parametrize("width", [1, 3, 8, 16, 33, 64, 65])
def test_signs_give_the_scores_of_products(width, monkeypatch):
    monkeypatch.setattr(vector_search, "SIGN_TILE", 7)
    monkeypatch.setattr(vector_search, "SIGN_RUN", 12)      # more than FEW documents at once, and some that are gone through alone
    rng = np.random.default_rng(width)
    docs = sign_lists(rng, [3, 0, None, 40, *rng.integers(1, 9, 30).tolist()], width)
    queries = sign_lists(rng, [5, 0, 1, 12, 30], width, 0.5)
    want = np.array([[maxsim(q, d) for d in docs] for q in queries])
    mine = vector_search.Multi(as_lists(queries))
    for theirs in (vector_search.Multi(as_lists(docs)), vector_search.Multi(packed(docs))):
        assert theirs.missing.tolist() == [d is None for d in docs]
        assert (theirs.signs is not None) == (width <= 64)
        assert np.allclose(mine.approximate(0, 5, theirs), want, atol=1e-12)
        assert np.allclose(mine.approximate(1, 4, theirs), want[1:4], atol=1e-12)
        at = np.divmod(np.arange(want.size), len(docs))
        assert np.allclose(mine.exact(*at, theirs).reshape(want.shape), want, atol=1e-12)


def test_exact_scores_are_sums_in_order_whatever_else_is_asked_for():
    """A score has the same bits alone or among pairs of other shapes, and those of a plain loop."""
    rng = np.random.default_rng(2)
    for make in (lambda n: rng.normal(size=(n, 5)).astype(np.float32), lambda n: sign_lists(rng, [n], 5, 0.3)[0]):
        queries, docs = [make(n) for n in (1, 9, 10, 21)], [make(n) for n in (2, 9, 10, 11, 40)]
        a, b = vector_search.Multi(as_lists(queries)), vector_search.Multi(as_lists(docs))
        q, d = np.divmod(np.arange(20), 5)
        got = a.exact(q, d, b)
        for i in range(20):
            assert got[i] == a.exact(q[i:i + 1], d[i:i + 1], b)[0]
            total = 0.0
            for x in queries[q[i]].astype(float).tolist():
                best = -np.inf
                for y in docs[d[i]].astype(float).tolist():
                    s = 0.0
                    for u, v in zip(x, y):
                        s += u * v
                    best = max(best, s)
                total += best
            assert got[i] == total


def test_vectors_of_unlike_magnitudes_are_multiplied():
    rng = np.random.default_rng(4)
    docs = [*sign_lists(rng, [3, 2], 6, 0.25), *sign_lists(rng, [4], 6, 0.75), rng.normal(size=(3, 6)).astype(np.float32)]
    queries = sign_lists(rng, [4, 2], 6)
    want = [[maxsim(q, d) for d in docs] for q in queries]
    for part in (packed(docs), as_lists(docs)):
        theirs = vector_search.Multi(part)
        assert theirs.signs is None
        assert np.allclose(vector_search.Multi(as_lists(queries)).approximate(0, 2, theirs), want, atol=1e-12)


def test_sign_vectors_are_neither_sorted_nor_multiplied_in_a_search(monkeypatch):
    """A block's documents have far more vectors than a search can sort and multiply for each block."""
    rng = np.random.default_rng(6)
    docs, queries = sign_lists(rng, [50] * 300, 16), sign_lists(rng, [20] * 10, 16)
    q = scan.QuerySet([str(i) for i in range(10)], None, vector_search.Multi(as_lists(queries)))
    block = scan.Block(np.array([f"{i:03}" for i in range(300)], object), None, vector_search.Multi(as_lists(docs)))
    monkeypatch.setattr(vector_search.Multi, "_maxima", None)
    got = scan._best(iter([block]), q, [1.0], 5, None)
    assert "_distinct" not in vars(block.vectors)
    for i in range(10):
        scores = np.array([maxsim(queries[i], d) for d in docs])
        assert [int(d) for _, d in got.lists[i]] == np.lexsort((np.arange(300), -scores.round(9)))[:5].tolist()


def test_tokens_are_runs_of_letters_and_digits():
    texts = ["", "A-b c_d 1.2", "Grüße, naïve… œuvre x y", "日本語、テスト 3", "a​b", "İstanbul K x́y", "\x1f\x85q"]
    for text in texts:
        assert embed._tokens(text) == [t for t in embed._TOKEN_SPLIT.split(text.lower()) if t]


def test_documents_keep_text_and_packed_vectors_without_a_join(spark, monkeypatch):
    """The index of rows that have their vectors needs no exchange, and ranks as the one of joined lists does,
    whatever the groups of its blocks."""
    from lumenrank.session import ship_package

    ship_package(spark)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(80)]
    docs = [(f"d{i}", " ".join(rng.choice(words, n))) for i, n in enumerate([0, 1, 1, 70, *rng.integers(0, 25, 60).tolist()])]
    docs += [("d900", None), ("d901", docs[3][1]), ("d902", docs[3][1])]
    corpus = spark.createDataFrame(docs, "id string, text string").repartition(2)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 6))) for i in range(7)] + [("qz", "...")], "id string, text string")
    qv = embed.embed(queries, embed.token_hashing_encoder, multi=True, out_id="query_id")
    own = embed.embed(corpus, embed.distinct_token_encoder, multi=True, packed=True, carry=("text",))
    assert [f.dataType.simpleString() for f in own.schema] == ["string", "binary", "double", "string"]
    plan = lexical.build_blocks(own, "doc_id", vectors=own, vector_col="vectors")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    joined = embed.embed(corpus, embed.distinct_token_encoder, multi=True)
    ranked = []
    for index in (lexical.build_index(own, "doc_id", vectors=own, vector_col="vectors"),
                  lexical.build_index(corpus, vectors=joined, vector_col="vectors")):
        assert index.n_docs == len(docs)
        found = fusion.hybrid_ranking(index, queries, qv, alphas=(0.0, 0.5, 1.0), max_k=4, kind="maxsim")
        ranked.append(sorted(map(tuple, found.select("alpha", "query_id", F.col("rank"), "doc_id", "score").collect())))
    assert ranked[0] == ranked[1] and len(ranked[0]) > 60

    source = scan.Source(index, kind="maxsim")
    q = scan.with_scales(source, next(scan.query_sets(lexical.query_weights(index, queries), qv, "maxsim")))
    parts = index.blocks.toArrow().combine_chunks().to_batches()
    lists, groups = [], []
    for most in (scan.GROUP_VECTORS, 120, 1):
        monkeypatch.setattr(scan, "GROUP_VECTORS", most)
        blocks = list(source.blocks(True)(iter(parts), q))
        groups.append(len(blocks))
        lists.append((sorted(scan._best(iter(blocks), q, (0.0, 0.5, 1.0), 4, None).rows()), scan._extremes(iter(blocks), q).to_pylist()))
    assert lists[0] == lists[1] == lists[2] and groups[0] == 1 < groups[1] <= groups[2]


def test_only_lists_are_packed(spark):
    with pytest.raises(ValueError):
        embed.embed(spark.createDataFrame([("a", "b")], "id string, text string"), packed=True)
