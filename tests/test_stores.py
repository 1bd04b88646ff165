import tempfile

import pytest
from pyspark.sql import functions as F

from lumenrank.sources import io, stores


def test_vector_store_round_trip(spark):
    root = tempfile.mkdtemp(prefix="lr-store-")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, vector array<float>")
    stores.save_vectors(v, root, "k1", {"model": "m", "dim": 2})
    assert stores.exists(spark, f"{root}/vectors", "cache_key", "k1")
    assert not stores.exists(spark, f"{root}/vectors", "cache_key", "k2")
    back = sorted((r.doc_id, list(r.vector)) for r in stores.load_vectors(spark, root, "k1").collect())
    assert back == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    assert stores.load_metadata(spark, root, "k1") == {"model": "m", "dim": "2"}
    assert stores.load_metadata(spark, root, "nope") == {}
    with pytest.raises(FileNotFoundError):
        stores.load_vectors(spark, root, "k2")


def test_multivector_and_results_store(spark):
    root = tempfile.mkdtemp(prefix="lr-store-")
    mv = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[0.5, 0.5]])],
                               "doc_id string, vectors array<array<float>>")
    stores.save_vectors(mv, root, "late", {"late_interaction": True})
    assert stores.load_vectors(spark, root, "late").where(F.size("vectors") == 2).count() == 1
    res = spark.createDataFrame([("e1", 0.5), ("e2", 0.7)], "eval_key string, `mrr@10` double")
    stores.save_results(res, f"{root}/results")
    grid = spark.createDataFrame([("e1",), ("e3",)], "eval_key string")
    assert [r.eval_key for r in stores.pending(grid, f"{root}/results").collect()] == ["e3"]


def test_retrieval_set_round_trip_and_loaders(spark):
    root = tempfile.mkdtemp(prefix="lr-set-")
    rs = io.RetrievalSet(spark.createDataFrame([("d1", "t")], "id string, text string"),
                         spark.createDataFrame([("q1", "x")], "id string, text string"),
                         spark.createDataFrame([("q1", "d1", 1.0)], "query_id string, corpus_id string, score double"))
    io.save_retrieval_set(rs, root)
    back = io.load_retrieval_set(spark, root)
    assert back.qrels.first()["corpus_id"] == "d1"
    with pytest.raises(ValueError):
        io.load_data(spark, f"{root}/x.txt")
    with pytest.raises(FileNotFoundError):
        io.load_data(spark, f"{root}/missing.csv")


def test_load_documents_assigns_ids(spark):
    root = tempfile.mkdtemp(prefix="lr-docs-")
    with open(f"{root}/docs.csv", "w") as f:
        f.write("text,ignored\nhello,1\nworld,2\n")
    d = io.load_documents(spark, f"{root}/docs.csv")
    assert d.columns == ["id", "text"]
    assert sorted(r.id for r in d.collect()) == ["doc_0", "doc_1"]
