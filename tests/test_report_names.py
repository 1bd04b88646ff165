import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import keys, text
from lumenrank.operators import catalog, compare, sampling
from lumenrank.sources import io
from lumenrank.sources.io import RetrievalSet


def test_labels(spark):
    df = spark.createDataFrame([("mrr@7", "20240229_081502", "x" * 60), ("hit_rate@12", "20240229-081502", "y" * 61),
                                ("recall", "now", ""), ("a@b@c", None, None)], "m string, s string, t string")
    got = df.select(compare.metric_label(F.col("m")).alias("m"), compare.date_label(F.col("s")).alias("s"),
                    compare.preview(F.col("t")).alias("t")).collect()
    assert [r.m for r in got] == ["MRR @7", "HIT_RATE @12", "RECALL", "A@B@C"]
    assert [r.s for r in got] == ["29.02.2024 08:15:02", "20240229-081502", "now", None]
    assert [r.t for r in got] == ["x" * 60, "y" * 60 + "...", "", None]


def _runs(spark):
    nan = float("nan")
    rows = [("a", "s1", 0.5, 0.25, nan, 4.0), ("b", "s2", 0.5, 0.75, 0.1, 8.0), ("c", "s3", 0.5, None, 0.1, 0.0),
            ("BM25", "BM25", 0.0, 0.5, None, 3.0)]
    results = spark.createDataFrame(rows, "model string, model_short string, alpha double, `mrr@7` double, "
                                    "`hit_rate@2` double, avg_embed_time_ms double")
    memory = spark.createDataFrame([("s1", -5.0, 1.0), ("s2", 40.0, -2.0), ("s3", nan, 7.0), ("s9", 40.0, 3.0)],
                                   "model_short string, peak_memory_mb double, model_memory_mb double")
    return results, memory


def test_report_cells(spark):
    got = {(r.model, r.column): (r.value, r.bar) for r in compare.report_cells(*_runs(spark), ["model"]).collect()}
    assert len(got) == 16
    assert [got[m, "mrr@7"] for m in ("a", "b", "c", "BM25")] == [(0.25, 0.0), (0.75, 100.0), (None, 0.0), (0.5, 50.0)]
    # a NaN is null, a range of one value has no bars
    assert [got[m, "hit_rate@2"] for m in ("a", "b", "c", "BM25")] == [(None, 0.0), (0.1, 0.0), (0.1, 0.0), (None, 0.0)]
    # the baseline has no latency; 0 is outside of the range
    assert [got[m, "avg_embed_time_ms"] for m in ("a", "b", "c", "BM25")] == [(4.0, 0.0), (8.0, 100.0), (0.0, 0.0), (None, 0.0)]
    assert [got[m, "memory_mb"] for m in ("a", "b", "c", "BM25")] == [(0.0, 0.0), (40.0, 0.0), (None, 0.0), (None, 0.0)]


def test_memory_order_and_missing_memory(spark):
    results, memory = _runs(spark)
    rows = [(r.model_short, r.peak_memory_mb, r.model_memory_mb) for r in compare.memory_rows(memory.where("model_short <> 's3'")).collect()]
    assert rows == [("s2", 40.0, 0.0), ("s9", 40.0, 3.0), ("s1", 0.0, 1.0)]
    size = {r.model: r.bubble_size for r in compare.report_bars(results, memory, "mrr@7").collect()}
    assert size["BM25"] == size["c"] == 300.0      # not measured


def test_quality_metric_rows(spark):
    long = spark.createDataFrame([("p", "mrr", 3), ("p", "mrr", 11), ("p", "hit_rate", 50), ("q", "hit_rate", 2), ("q", "hit_rate", 9),
                                  ("r", "recall", 5), ("s", "mrr", None)], "g string, metric string, k long")
    got = {r.g: (r.quality_metric, r.error is None) for r in compare.quality_metric_rows(long, ["g"]).collect()}
    assert got == {"p": ("mrr@11", True), "q": ("hit_rate@9", True), "r": (None, False), "s": (None, False)}
    got = {r.g: r.quality_metric for r in compare.quality_metric_rows(long, ["g"], "mrr@3").collect()}
    assert got == {"p": "mrr@3", "q": None, "r": None, "s": None}


def test_record_fields_fall_back(spark):
    t = spark.createDataFrame([("p", "n", "r", "v"), ("", "n", "r", None), (None, "", "r", ""), (None, None, None, "v")],
                              "path string, name string, repo_id string, revision string")
    got = catalog.record_fields(t).select("dataset_path", "dataset_revision").collect()
    assert [tuple(r) for r in got] == [("p", "v"), ("n", ""), ("r", ""), ("", "v")]
    bare = catalog.record_fields(t.select(F.col("repo_id"))).select("dataset_path", "dataset_revision").collect()
    assert [tuple(r) for r in bare] == [("r", ""), ("r", ""), ("r", ""), ("", "")]


def test_fingerprint_follows_rows_not_order(spark):
    def of(rows):
        df = spark.createDataFrame(rows, "g string, id string, text string").repartition(3)
        return {r.g: r.content for r in keys.content_fingerprints(df, ["g"], ["id", "text"]).collect()}
    a = of([("x", "1", "t"), ("x", "2", None), ("y", "1", "t")])
    assert a == of([("y", "1", "t"), ("x", "2", None), ("x", "1", "t")])
    assert a["x"] != of([("x", "1", "t"), ("x", "2", "")])["x"] and a["y"] != of([("y", "1", "t"), ("y", "1", "t")])["y"]
    assert of([("x", "ab", "c")]) != of([("x", "a", "bc")])
    one = spark.range(1)
    plain, keyed = (one.select(keys.embedding_key(F.lit("p"), F.lit("o/m"), "documents", None, c)).first()[0] for c in (None, F.lit("f")))
    assert plain != keyed and plain.rsplit("_", 1)[0] == keyed.rsplit("_", 1)[0] == "p_m_documents"


def test_truncate_by_tokenizer(spark):
    def load():
        return (lambda t: [ord(c) for c in t]), (lambda ids: "".join(map(chr, ids)))
    df = spark.createDataFrame([("abc",), ("abcd",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.truncate_by_tokenizer("t", 3, load)).collect()] == ["abc", "abc", "", None]
    with pytest.raises(ValueError):
        text.truncate_by_tokenizer("t", 0, load)


def test_truncate_by_a_tokenizer_file(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.cut for r in docs.select("doc_id", text.truncate_by_tokenizer("text", 40, text.tokenizer_file(path)).alias("cut")).collect()}
    tok, shorter = Tokenizer.from_file(path), 0
    for r in docs.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (r.text if len(ids) <= 40 else tok.decode(ids[:40], skip_special_tokens=False))
        shorter += len(ids) > 40
    assert shorter


def test_one_row_group_is_encoded_by_several_tasks(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from lumenrank.plans.registry_more import truncate_model_tokens

    rows = spark.range(400).selectExpr("id AS doc_id", "repeat(sha1(cast(id AS string)), 50) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(key, "1k")
    try:
        got = truncate_model_tokens(spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    assert len(got) == 400 and len({r.p for r in got}) > 1


def test_ids_follow_files_and_rows(spark):
    root = tempfile.mkdtemp(prefix="lr-files-")
    sizes = [1, 400, 7, 90, 0, 3000]       # larger files come first in Spark's own order
    want = []
    for i, n in enumerate(sizes):
        rows = [(f"{i}:{j} " + "z" * 50,) for j in range(n)]
        want += [r[0] for r in rows]
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{root}/tmp{i}")
        part = next(f for f in os.listdir(f"{root}/tmp{i}") if f.endswith(".parquet"))
        os.makedirs(f"{root}/docs.parquet", exist_ok=True)
        os.rename(f"{root}/tmp{i}/{part}", f"{root}/docs.parquet/part-{i}.parquet")
    got = {r.id: r.text for r in io.load_documents(spark, f"{root}/docs.parquet").collect()}
    assert [got[f"doc_{i}"] for i in range(len(want))] == want and len(got) == len(want)


def _set(spark, queries=("q1", "q2"), positive=1.0):
    corpus = spark.createDataFrame([(f"d{i}", "t") for i in range(5)], "id string, text string")
    q = spark.createDataFrame([(x, "t") for x in queries], "id string, text string")
    qrels = spark.createDataFrame([("q1", "d0", 1.0), ("q2", "d1", positive)], "query_id string, corpus_id string, score double")
    return RetrievalSet(corpus, q, qrels)


def test_sampling_checks_its_input(spark):
    """All queries with a judgment stay if the corpus is no larger; broken rules raise."""
    s = sampling.sample(_set(spark, ("q1", "q2", "idle")), corpus_size=9, seed=3)
    assert sorted(r.id for r in s.data.queries.collect()) == ["q1", "q2"] and s.data.corpus.count() == 5
    assert s.stats.first()["original_query_size"] == 2
    for bad in (_set(spark, ("q1",)), _set(spark, positive=0.0), _set(spark, ("q1", "q2", "idle", "idle")), _set(spark, positive=math.inf)):
        with pytest.raises(ValueError):
            sampling.sample(bad, corpus_size=3, seed=3)
