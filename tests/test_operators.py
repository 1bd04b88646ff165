import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import catalog, compare, containment, fusion, generate, sampling, validate
from lumenrank.operators.ids import dense_ids
from lumenrank.sources.io import RetrievalSet


def test_pareto_equal_and_missing(spark):
    rows = [("p", "m1", "m1", 0.5, 10.0), ("p", "m2", "m2", 0.5, 10.0), ("p", "m3", "m3", 0.5, 11.0),
            ("p", "m4", "m4", 0.9, 40.0), ("p", "BM25", "BM25", 1.0, 0.0), ("p", "m5", "m5", None, 1.0)]
    df = spark.createDataFrame(rows, "project string, model string, model_short string, "
                                     "`mrr@10` double, avg_embed_time_ms double")
    got = {r.model: r.is_pareto for r in compare.pareto_flags(df, "mrr@10").collect()}
    assert got == {"m1": True, "m2": True, "m3": False, "m4": True, "BM25": None, "m5": None}


def test_quality_choice():
    assert compare.select_quality_metric(["model", "mrr@1", "hit_rate@50", "mrr@20"]) == "mrr@20"
    assert compare.select_quality_metric(["hit_rate@3", "hit_rate@10"]) == "hit_rate@10"
    assert compare.select_quality_metric(["mrr@1", "x"], "x") == "x"
    for bad in (["model"], None), (["mrr@1"], "mrr@3"):
        with pytest.raises(ValueError):
            compare.select_quality_metric(*bad)


def test_costs_keep_models_of_one_label_apart(spark):
    runs = spark.createDataFrame([("a/e5", "e5", 10.0, 5), ("b/e5", "e5", 90.0, 5), ("BM25", "BM25", 0.0, 5)],
                                 "model string, model_short string, total_embed_time_ms double, num_documents long")
    got = {r.model: r.cost_percent for r in compare.cost_percent(compare.cost_per_model(runs)).collect()}
    assert got == {"a/e5": pytest.approx(100 / 9, abs=1e-6), "b/e5": 100.0}


def test_names_strip_versions_and_aliases(spark):
    bench = spark.createDataFrame([("MTEB(deu, v1)", None), ("MTEB(deu)", None), ("A", "same"), ("B", "same")],
                                  "name string, alias string")
    asked = spark.createDataFrame([("\tde\n",), ("same",)], "user_value string")
    got = sorted((r.user_value, r.resolved) for r in catalog.resolve_names(asked, bench).collect())
    assert got == [("\tde\n", "MTEB(deu, v1)"), ("same", "B")]


def test_explicit_limits(spark):
    df = spark.createDataFrame([("one two three four\nb\nc",)], "t string")
    row = df.select(generate.prompt(F.col("t"), 2, max_tokens=2, template="{document_text}|{num_queries}").alias("p"),
                    generate.parse_lines(F.col("t")).alias("all"), generate.parse_lines(F.col("t"), 2).alias("two")).first()
    assert row.p.startswith("one two") and "three" not in row.p and row.p.endswith("|2")
    assert row["all"] == ["one two three four", "b", "c"] and row.two == ["one two three four", "b"]


def test_pareto_matches_pairwise(spark):
    rnd = random.Random(3)
    rows = [("p%d" % rnd.randint(0, 2), "m%d" % i, "s", float(rnd.randint(0, 5)), float(rnd.randint(1, 5)))
            for i in range(200)]
    df = spark.createDataFrame(rows, "project string, model string, model_short string, "
                                     "`mrr@10` double, avg_embed_time_ms double")
    got = {r.model: r.is_pareto for r in compare.pareto_flags(df, "mrr@10").collect()}
    for p, m, _, q, l in rows:
        dominated = any(p2 == p and m2 != m and q2 >= q and l2 <= l and (q2 > q or l2 < l)
                        for p2, m2, _, q2, l2 in rows)
        assert got[m] == (not dominated)


def test_parse_lines(spark):
    text = "1. first query\n\n- second\n   \n3D printing\n2024 budget\n1.\nextra"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    out = [r.q for r in df.select(generate.parse_lines(F.col("t"), 5).alias("q")).collect()]
    assert out[0] == ["first query", "second", "D printing", "budget", ""]
    assert out[1] == []


def test_call_model_retries_then_gives_up(spark):
    df = spark.createDataFrame([("1", "p")], "doc_id string, prompt string")

    def failing():
        def gen(_p):
            raise RuntimeError("boom")
        return gen
    out = generate.call_model(df, failing, sleep=lambda s: None).first()
    assert out["content"] is None


def test_dense_ids_sequential(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"))
    r = dense_ids(df, "i", ["k"]).collect()
    order = sorted(r, key=lambda x: x.i)
    assert [x.i for x in order] == list(range(1000))
    assert [x.k for x in order] == sorted(x.k for x in r)


def test_containment_matches_brute_force(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "xx beta gamma deltaz"), (3, "nothing here at all"),
            (4, "pre alpha beta gamma delta post")]
    docs += [(5, "a\U0001f600b long-unbroken-run-of-signs here"), (6, ""), (7, None)]
    items = [(10, "alpha beta gamma"), (11, "beta gamma delta"), (12, "at"), (13, "zzz yyy xxx"), (14, "\U0001f600"), (15, "a"),
             (16, "long-unbroken-run-of-signs"), (17, "long-unbroken-run-of-sounds"), (18, "gamma del"), (19, None), (20, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in containment.pairs(d, b).collect())
    want = sorted((i, di) for i, t in items for di, dt in docs if t and dt and t in dt)
    assert got == want


def _brute_maxsim(q, d):
    return sum(max(float(np.dot(a, b)) for b in d) for a in q)


def test_vector_search_kernels_vs_brute_force(spark):
    rng = np.random.default_rng(0)
    docs = [(str(i), rng.normal(size=4).tolist()) for i in range(40)]
    qs = [(str(i), rng.normal(size=4).tolist()) for i in range(7)]
    dv = spark.createDataFrame(docs, "doc_id string, vector array<double>")
    qv = spark.createDataFrame(qs, "query_id string, vector array<double>")
    got = fusion.semantic_ranking(dv, qv, 3).collect()
    for qid, qvec in qs:
        scores = sorted(((round(float(np.dot(qvec, v)), 9), d) for d, v in docs), key=lambda x: (-x[0], x[1]))
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == \
            [d for _, d in scores[:3]]
    mdocs = [(str(i), [rng.normal(size=3).tolist() for _ in range(rng.integers(1, 4))]) for i in range(15)]
    mqs = [(str(i), [rng.normal(size=3).tolist() for _ in range(2)]) for i in range(3)]
    mdv = spark.createDataFrame(mdocs, "doc_id string, vectors array<array<double>>")
    mqv = spark.createDataFrame(mqs, "query_id string, vectors array<array<double>>")
    got = fusion.semantic_ranking(mdv, mqv, 2, kind="maxsim").collect()
    for qid, qm in mqs:
        scores = sorted(((round(_brute_maxsim(qm, dm), 9), d) for d, dm in mdocs), key=lambda x: (-x[0], x[1]))
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == \
            [d for _, d in scores[:2]]


def _sequential_greedy(order, pos, budget):
    sel, S = [], set()
    for q in order:
        nxt = S | pos[q]
        if not sel or len(nxt) <= budget:
            sel.append(q)
            S = nxt
    return sel


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_sampling_matches_sequential(spark, seed):
    import hashlib
    rnd = random.Random(seed)
    pos = {f"q{i}": {f"d{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 5))} for i in range(40)}
    budget = 12
    queries = spark.createDataFrame([(q, q) for q in pos], "id string, text string")
    P = spark.createDataFrame([(q, d) for q, ds in pos.items() for d in ds], "query_id string, doc_id string")
    got = {r.query_id for r in sampling.greedy_queries(queries, P, budget, seed).collect()}
    order = sorted(pos, key=lambda q: (hashlib.md5(f"{q}:{seed}".encode()).hexdigest(), q))
    assert got == set(_sequential_greedy(order, pos, budget))


def _by_seed(ids, seed):
    import hashlib
    return sorted(ids, key=lambda q: (hashlib.md5(f"{q}:{seed}".encode()).hexdigest(), q))


def _greedy(spark, pos, budget, seed):
    queries = spark.createDataFrame([(q, q) for q in pos], "id string, text string")
    pairs = spark.createDataFrame([(q, d) for q, ds in pos.items() for d in ds], "query_id string, doc_id string")
    rounds = [{r.query_id for r in part.collect()} for part in sampling.greedy_rounds(queries, pairs, budget, seed)]
    return set().union(*rounds), len(rounds)


def test_greedy_rounds_stay_logarithmic(spark):
    """One small query, then one that needs all that was free before it: an overflow at each second query."""
    order = _by_seed([f"q{i}" for i in range(121)], 5)
    pos = {order[0]: {"start"}}
    for i, q in enumerate(order[1:]):
        pos[q] = {f"s{i}"} if i % 2 == 0 else {f"b{i}-{j}" for j in range(60 - i // 2)}
    got, rounds = _greedy(spark, pos, 61, 5)
    assert got == set(_sequential_greedy(order, pos, 61)) and rounds <= 8


@pytest.mark.parametrize("seed,budget", [(4, 9), (5, 30), (6, 60)])
def test_greedy_with_large_and_overlapping_queries(spark, seed, budget):
    rnd = random.Random(seed)
    pos = {f"q{i}": {f"d{rnd.randint(0, 90)}" for _ in range(rnd.choice([0, 1, 2, 9, 25]))} for i in range(60)}
    got, rounds = _greedy(spark, pos, budget, seed)
    assert got == set(_sequential_greedy(_by_seed(pos, seed), pos, budget)) and rounds <= math.log2(budget) + 3


@pytest.mark.parametrize("seed,budget", [(7, 9), (8, 40), (9, 300)])
def test_greedy_slices_match_sequential(spark, monkeypatch, seed, budget):
    monkeypatch.setattr(sampling, "SLICE_QUERIES", 4)
    rnd = random.Random(seed)
    pos = {f"q{i}": {f"d{rnd.randint(0, 150)}" for _ in range(rnd.choice([0, 1, 2, 9, 25]))} for i in range(120)}
    got, _ = _greedy(spark, pos, budget, seed)
    assert got == set(_sequential_greedy(_by_seed(pos, seed), pos, budget))


def test_greedy_rounds_leave_queries_behind_the_budget_alone(spark, monkeypatch):
    """Once the budget has run out, only queries that need nothing more are kept, not the pairs of all others."""
    monkeypatch.setattr(sampling, "SLICE_QUERIES", 50, raising=False)
    rows, cut = [], sampling.cut_lineage
    monkeypatch.setattr(sampling, "cut_lineage", lambda df: rows.append((out := cut(df)).count()) or out)
    rnd = random.Random(10)
    pos = {f"q{i}": {f"d{rnd.randint(0, 999)}" for _ in range(4)} for i in range(3000)}
    got, _ = _greedy(spark, pos, 60, 10)
    assert got == set(_sequential_greedy(_by_seed(pos, 10), pos, 60))
    assert sum(rows) < 3000


def test_sampling_keeps_positives_above_target(spark):
    corpus = spark.createDataFrame([(f"d{i}", "t") for i in range(4)], "id string, text string")
    queries = spark.createDataFrame([("q1", "t")], "id string, text string")
    qrels = spark.createDataFrame([("q1", "d0", 1.0), ("q1", "d1", 1.0), ("q1", "d2", 1.0)],
                                  "query_id string, corpus_id string, score double")
    s = sampling.sample(RetrievalSet(corpus, queries, qrels), corpus_size=2, seed=7)
    assert s.data.corpus.count() == 3
    with pytest.raises(ValueError):
        sampling.sample(RetrievalSet(corpus, queries, qrels), corpus_size=0, seed=7)


def test_sampling_deterministic_and_seeded(spark):
    corpus = spark.createDataFrame([(f"d{i}", "t") for i in range(1, 13)], "id string, text string")
    queries = spark.createDataFrame([(f"q{i}", "t") for i in range(1, 7)], "id string, text string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1.0) for i in range(1, 7)],
                                  "query_id string, corpus_id string, score double")
    rs = RetrievalSet(corpus, queries, qrels)
    a = sorted(r.id for r in sampling.sample(rs, 5, 7).data.corpus.collect())
    b = sorted(r.id for r in sampling.sample(rs, 5, 7).data.corpus.collect())
    others = {tuple(sorted(r.id for r in sampling.sample(rs, 5, s).data.corpus.collect()))
              for s in range(8, 14)}
    assert a == b and len(a) == 5 and len(others | {tuple(a)}) > 1


def test_violations_rules(spark):
    corpus = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id long, text string")
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "id string, text string")
    qrels = spark.createDataFrame([("q1", "1", "high"), ("q1", "2", "1"), ("q2", "2", "0"), ("q9", "7", "1")],
                                  "query_id string, corpus_id string, score string")
    v = {(r.table_name, r.rule): (r.n, r.sample_id)
         for r in validate.violations(RetrievalSet(corpus, queries, qrels)).collect()}
    assert v[("corpus", "id_unique")] == (1, "1")
    assert v[("corpus", "text_present")] == (1, "2")
    assert v[("qrels", "score_finite")] == (1, "q1")
    assert v[("qrels", "query_id_exists")] == (1, "q9")
    assert v[("qrels", "corpus_id_exists")] == (1, "7")
    assert v[("queries", "has_positive")] == (1, "q2")
    with pytest.raises(ValueError):
        validate.validated(RetrievalSet(corpus, queries, qrels))


def test_rejected_rows_name_every_row_left_out(spark):
    corpus = spark.createDataFrame([("x", "1", "b"), ("y", "1", "a"), ("z", "2", None), ("z", None, "t"), ("z", "3", "c")],
                                   "id string, _id string, text string")
    queries = spark.createDataFrame([("q1", "x")], "_id string, text string")
    qrels = spark.createDataFrame([("q1", "1", "1"), ("q1", "2", "1"), ("q1", "3", "inf"), ("q9", "3", "1"), ("q9", "7", "no")],
                                  "query_id string, corpus_id string, score string")
    rs = RetrievalSet(corpus, queries, qrels)
    got = {(r.table_name, r.rule, r.query_id, r.corpus_id): r.n for r in validate.rejected_rows(rs).collect()}
    assert got == {("corpus", "text_present", None, "2"): 1, ("corpus", "id_not_null", None, None): 1,
                   ("corpus", "id_unique", None, "1"): 1, ("qrels", "corpus_id_exists", "q1", "2"): 1,
                   ("qrels", "score_finite", "q1", "3"): 1, ("qrels", "query_id_exists", "q9", "3"): 1,
                   ("qrels", "score_finite", "q9", "7"): 1}
    kept = validate.clean(rs)
    assert sorted(map(tuple, kept.corpus.select("id", "text").collect())) == [("1", "a"), ("3", "c")]
    assert kept.qrels.count() == 1


def test_missing_columns(spark):
    corpus = spark.createDataFrame([(1,)], "id long")
    queries = spark.createDataFrame([("q1", "x")], "id string, text string")
    qrels = spark.createDataFrame([("q1", "1")], "query_id string, corpus_id string")
    with pytest.raises(ValueError):
        validate.violations(RetrievalSet(corpus, queries, qrels))


def test_default_score_added(spark):
    corpus = spark.createDataFrame([("d1", "t")], "id string, text string")
    queries = spark.createDataFrame([("q1", "x")], "id string, text string")
    qrels = spark.createDataFrame([("q1", "d1")], "query_id string, corpus_id string")
    rs = validate.validated(RetrievalSet(corpus, queries, qrels))
    assert rs.qrels.first()["score"] == 1.0


def test_catalog_codes_and_resolution(spark):
    from lumenrank.operators import catalog
    df = spark.createDataFrame([("de",), (" GER ",), ("zh",), ("eng",), ("xx",)], "c string")
    assert [r.n for r in df.select(catalog.normalise_lang(F.col("c")).alias("n")).collect()] == \
        ["deu", "deu", "cmn", "eng", "xx"]
    v = spark.createDataFrame([("v2",), ("vx",), ("classic",), ("other",)], "v string")
    assert [r.r for r in v.select(catalog.version_rank(F.col("v")).alias("r")).collect()] == [102, 10, 1, 0]
    bench = spark.createDataFrame([("MTEB(deu, v1)", None), ("MTEB(eng, v2)", "MTEB(en)"), ("BEIR", None)],
                                  "name string, alias string")
    req = spark.createDataFrame([("de",), ("MTEB(en, v2)",), ("MTEB(en)",), ("BEIR",), ("fr",)], "user_value string")
    got = {r.user_value: r.resolved for r in catalog.resolve_names(req, bench).collect()}
    assert got == {"de": "MTEB(deu, v1)", "MTEB(en, v2)": "MTEB(eng, v2)", "MTEB(en)": "MTEB(eng, v2)",
                   "BEIR": "BEIR", "fr": "MTEB(fra, v2)"}
    cfg = spark.createDataFrame([("d", c) for c in ["en-corpus", "en-queries", "en-qrels", "de-corpus",
                                                    "de-queries", "incomplete-corpus"]], "dataset string, config string")
    assert [r.lang for r in catalog.complete_groups(cfg).collect()] == ["en"]
