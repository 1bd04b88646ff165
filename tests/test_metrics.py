import pytest
from pyspark.sql import functions as F

from lumenrank.operators import metrics


def _ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, doc_id string")


def test_cutoffs_over_three_queries(spark):
    # first relevant ranks 1, 4 and none
    rows = [(q, r, f"{q}-{r}") for q in "xyz" for r in range(1, 6)]
    qrels = spark.createDataFrame([("x", "x-1", 1.0), ("x", "x-5", 1.0), ("y", "y-4", 2.0), ("z", "z-9", 1.0)],
                                  "query_id string, corpus_id string, score double")
    m = metrics.compute_metrics(_ranking(spark, rows), qrels, 3, {"mrr": [1, 5], "hit_rate": [3, 4]}).first()
    assert m["mrr@1"] == pytest.approx(1 / 3) and m["mrr@5"] == pytest.approx((1 + 1 / 4) / 3)
    assert m["hit_rate@3"] == pytest.approx(1 / 3) and m["hit_rate@4"] == pytest.approx(2 / 3)


def test_queries_without_hits_count(spark):
    ranked = _ranking(spark, [("q1", 1, "d1")])
    qrels = spark.createDataFrame([("q1", "d1", 1.0), ("q2", "d9", 1.0)],
                                  "query_id string, corpus_id string, score double")
    m = metrics.compute_metrics(ranked, qrels, 2, {"mrr": [10], "hit_rate": [10]}).first()
    assert m["mrr@10"] == 0.5 and m["hit_rate@10"] == 0.5


def test_score_zero_is_not_relevant(spark):
    ranked = _ranking(spark, [("q1", 1, "d1")])
    qrels = spark.createDataFrame([("q1", "d1", 0.0)], "query_id string, corpus_id string, score double")
    m = metrics.compute_metrics(ranked, qrels, 1, {"mrr": [1], "hit_rate": [1]}).first()
    assert m["mrr@1"] == 0.0


def test_empty_query_set_raises(spark):
    ranked = _ranking(spark, [("q1", 1, "d1")])
    qrels = spark.createDataFrame([("q1", "d1", 1.0)], "query_id string, corpus_id string, score double")
    with pytest.raises(ValueError):
        metrics.compute_metrics(ranked, qrels, 0)


@pytest.mark.parametrize("bad", [
    {"hit_rate": [2, 4]},
    {"mrr": [5, -2], "hit_rate": [5]},
    {"mrr": [[5]], "hit_rate": [5]},
    {"mrr": [5], "hit_rate": ["5"]},
    {"mrr": [5.0], "hit_rate": [5]},
    {"mrr": [5], "hit_rate": [False, 5]},
    {"mrr": [5], "hit_rate": ()},
])
def test_cutoff_validation(bad):
    with pytest.raises((ValueError, TypeError)):
        metrics.validate_cutoffs(bad)


def test_legacy_cutoffs():
    assert metrics.resolve_cutoffs(top_k=5) == {"mrr": [5], "hit_rate": [5]}
    assert metrics.resolve_cutoffs() == {"mrr": [10], "hit_rate": [10]}
    assert metrics.max_k({"mrr": [1, 3, 10], "hit_rate": [3]}) == 10
    assert metrics.parse_metric_name("mrr@10") == ("mrr", 10)


def test_relevance_lists_graded_and_string_ids(spark):
    queries = spark.createDataFrame([("1", "q")], "id string, text string")
    qrels = spark.createDataFrame([("1", "10", 2.0), ("1", "20", 0.0)],
                                  "query_id string, corpus_id string, score double")
    r = metrics.relevance_lists(queries, qrels).first()
    assert r["relevant_ids"] == ["10"]
