"""Block search, fusion in the partition and encoders against brute force."""
import math
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from lumenrank.operators import embed, fusion, lexical, scan, topk


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    from lumenrank.session import ship_package

    ship_package(spark)


def words(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def half_up(x):
    return float(Decimal(repr(float(x))).quantize(Decimal("1e-9"), ROUND_HALF_UP))


@pytest.fixture(scope="module")
def data():
    rnd, rng = random.Random(7), np.random.default_rng(7)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = [(f"d{i}", " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 20, 200])))) for i in range(150)]
    docs += [("d900", docs[3][1]), ("d901", None), ("d902", "")]
    vectors = {d: rng.normal(size=6).tolist() for d, _ in docs}
    vectors["d5"] = vectors["d6"] = vectors["d7"]
    queries = [(f"q{i}", " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 4, 30])))) for i in range(12)] + [("qz", "unseen")]
    qvec = {q: rng.normal(size=6).tolist() for q, _ in queries}
    qvec["q3"] = [0.0] * 6
    return docs, vectors, queries, qvec


def bm25(docs, queries):
    texts = {d: words(t) for d, t in docs}
    n, avgdl = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    out = {}
    for q, text in queries:
        for d, t in texts.items():
            tf, s = Counter(t), 0.0
            for w, m in Counter(words(text)).items():
                if tf[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += m * idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
            if s > 0:
                out[q, d] = half_up(s)
    return out


def ranked(scores, k):
    return [(d, s) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


def brute_hybrid(data, alpha, k, cap, vectors=True):
    docs, dv, queries, qv = data
    lex = bm25(docs, queries)
    out = {}
    for q, _ in queries:
        mine = dict(ranked({d: s for (x, d), s in lex.items() if x == q}, cap or len(docs)))
        sem = {}
        for d, _ in docs:
            total = 0.0
            for a, b in zip(qv[q], dv[d]):
                total += a * b
            sem[d] = total
        if alpha == 0.0:
            out[q] = ranked({d: s for (x, d), s in lex.items() if x == q}, k)
            continue
        if alpha == 1.0:
            out[q] = ranked({d: half_up(s) for d, s in sem.items()}, k)
            continue
        lo, hi = min(sem.values()), max(sem.values())
        lmin, lmax = (min(mine.values()), max(mine.values())) if mine else (0, 0)
        norm = lambda x, a, b: 1.0 if a == b else (x - a) / (b - a)
        out[q] = ranked({d: half_up(alpha * norm(sem[d], lo, hi) + (1 - alpha) * (norm(mine[d], lmin, lmax) if d in mine else 0.0))
                         for d, _ in docs}, k)
    return {(q, r + 1): x for q, rows in out.items() for r, x in enumerate(rows)}


def frames(spark, data):
    docs, dv, queries, qv = data
    return (spark.createDataFrame(docs, "id string, text string").repartition(3),
            spark.createDataFrame(list(dv.items()), "doc_id string, vector array<double>"),
            spark.createDataFrame(queries, "id string, text string"),
            spark.createDataFrame(list(qv.items()), "query_id string, vector array<double>"))


@pytest.mark.parametrize("cap,sets", [(None, 1), (7, 1), (7, 3), (1, 1)])
def test_hybrid_grid(spark, data, cap, sets, monkeypatch):
    corpus, dv, queries, qv = frames(spark, data)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    if sets > 1:
        monkeypatch.setattr(scan, "QUERY_ROWS", 5)
        monkeypatch.setattr(lexical, "CELLS", 20)
    index = lexical.build_index(corpus, vectors=dv)
    alphas = [0.0, 0.3, 0.75, 1.0]
    got = fusion.hybrid_ranking(index, queries, qv, alphas, max_k=5, cap=cap).collect()
    for alpha in alphas:
        want = brute_hybrid(data, alpha, 5, cap)
        rows = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in got if r.alpha == alpha}
        assert {k: d for k, (d, _) in rows.items()} == {k: d for k, (d, _) in want.items()}
        assert all(rows[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)


def test_lexical_skips_blocks_and_finds_the_same(spark, data, monkeypatch):
    docs, _, queries, _ = data
    corpus, _, q, _ = frames(spark, data)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    index = lexical.build_index(corpus.coalesce(1))
    report = scan.Report(spark)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in fusion.lexical_ranking(index, q, 2, report).collect()}
    want = brute_hybrid(data, 0.0, 2, None)
    assert {k: d for k, (d, _) in got.items()} == {k: d for k, (d, _) in want.items()}
    assert 0 < report.read.value < report.offered.value
    every = {(r.query_id, r.doc_id): r.score for r in fusion.lexical_matches(index, q).collect()}
    assert every == pytest.approx(bm25(docs, queries), abs=2e-9)
    df = Counter(w for _, t in docs for w in set(words(t)))
    assert {r.term: r.df for r in index.terms.collect()} == df


def test_no_more_than_k_rows_leave_a_task(spark):
    """A zero query vector ties with every document."""
    docs = spark.range(5000).selectExpr("cast(id as string) as doc_id", "array(1.0D, cast(id as double)) as vector").repartition(2)
    queries = spark.createDataFrame([("q", [0.0, 0.0])], "query_id string, vector array<double>")
    source = scan.Source(doc_vecs=docs)
    q = next(scan.query_sets(None, queries, "dense"))
    found = scan._run(source, q, False, True, scan.TOPK, lambda blocks, s: [
        __import__("pyarrow").RecordBatch.from_pylist([{"alpha": 1.0, "query_id": "q", "doc_id": d, "score": x}
                                                       for _, d, x in scan._best(blocks, s, [1.0], 3, None).rows()])])
    assert found.count() <= 3 * docs.rdd.getNumPartitions()
    assert [r.doc_id for r in fusion.semantic_ranking(docs, queries, 3).orderBy("rank").collect()] == ["0", "1", "10"]


def test_constant_scores_normalise_to_one(spark):
    docs = spark.createDataFrame([(f"d{i}", "x y") for i in range(100)], "id string, text string")
    rng = np.random.default_rng(1)
    vector = rng.normal(size=64).tolist()
    dv = spark.createDataFrame([(f"d{i}", vector) for i in range(100)], "doc_id string, vector array<double>")
    queries = spark.createDataFrame([("q", "x")], "id string, text string")
    qv = spark.createDataFrame([("q", rng.normal(size=64).tolist())], "query_id string, vector array<double>")
    rows = fusion.hybrid_ranking(lexical.build_index(docs, vectors=dv), queries, qv, [0.4], max_k=3).collect()
    assert sorted((r["rank"], r.doc_id, r.score) for r in rows) == [(1, "d0", 1.0), (2, "d1", 1.0), (3, "d10", 1.0)]


def test_rounding_is_sparks(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    values = [rnd.uniform(-50, 50) for _ in range(500)] + [k + 0.5e-9 for k in range(20)] + [1.0000000005, 2.5e-9, -2.5e-9, 0.1234567895]
    want = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 9).alias("y")).collect()]
    assert topk.rounded(np.array(values)).tolist() == want


def test_encoders(spark):
    texts = spark.createDataFrame([("a", "One two, TWO."), ("b", ""), ("c", None)], "id string, text string")
    rows = {r.doc_id: r.vectors for r in embed.embed(texts, embed.token_hashing_encoder, multi=True).collect()}
    assert len(rows["a"]) == 3 and rows["a"][1] == rows["a"][2] and rows["b"] == [] and rows["c"] == []
    assert {abs(x) for v in rows["a"] for x in v} == {0.25}
    rows = {r.doc_id: r.vectors for r in embed.embed(texts, embed.distinct_token_encoder, multi=True).collect()}
    assert len(rows["a"]) == 2
    cost = embed.embedding_cost(embed.embed(texts)).first()
    assert cost.num_documents == 3 and cost.avg_embed_time_ms == pytest.approx(cost.total_embed_time_ms / 3)


def test_remote_batches_retry_and_report_failures(spark):
    texts = spark.createDataFrame([(str(i), f"text {i}") for i in range(25)], "id string, text string").coalesce(1)

    def transport():
        calls = Counter()

        def send(batch):
            calls[batch[0]] += 1
            if "text 10" in batch:
                raise ConnectionError("gone")
            if "text 4" in batch and calls[batch[0]] < 3:
                return [[1.0]]                      # a wrong number of vectors
            return [[float(len(t)), 0.5] for t in batch]
        return send

    rows = embed.embed_remote(texts, transport, batch_size=4, retries=2, workers=3, sleep=lambda s: None).collect()
    assert [r.doc_id for r in rows] == [str(i) for i in range(25)]
    for r in rows:
        if 8 <= int(r.doc_id) < 12:
            assert r.vector is None and r.error == "ConnectionError: gone" and r.attempts == 3
        else:
            assert r.vector == [float(len(f"text {r.doc_id}")), 0.5] and r.error is None
            assert r.attempts == (3 if 4 <= int(r.doc_id) < 8 else 1)


def test_vector_count(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    embed.check_vector_count(texts, embed.embed(texts))
    for wrong in (embed.embed(texts.where("id = 'a'")), embed.embed(texts.union(texts)),
                  embed.embed(texts.union(spark.createDataFrame([("c", "z")], texts.schema)))):
        with pytest.raises(ValueError):
            embed.check_vector_count(texts, wrong)
