import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import quality
from lumenrank.llm.tables import fold, scratch


def test_training_takes_every_labelled_row(spark):
    """More rows than the 20,000 that training took before: the cut is their exact quantile, the mean is theirs."""
    i = F.col("doc_id")
    texts = F.concat_ws(" ", F.lit("Some"), F.sha1(i.cast("string")), F.expr("repeat('word, ', int(doc_id % 17))"), F.expr("repeat('XY | ', int(doc_id % 5))"))
    docs = spark.range(27_000).select(F.col("id").alias("doc_id")).select("doc_id", texts.alias("text"))
    labels = docs.select("doc_id", F.when(i % 5 > 2, 0).otherwise(1).alias("quality"))
    ranker = quality.train(docs, labels)
    rows = quality.add_scores(docs, ranker).where(fold("doc_id", 5) != 0).join(labels, "doc_id").select("_raw", "quality").toPandas()
    assert len(rows) > quality.MAX_TRAIN
    assert ranker.cut == pytest.approx(np.quantile(rows._raw, (rows.quality == 0).mean()), rel=1e-9)
    assert rows._raw[rows.quality == 1].mean() > rows._raw[rows.quality == 0].mean() + 1


def _rows(spark, n, bad):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, quality.N_FEATURES))
    label = np.array([0 if k % (n // bad) == 0 and k // (n // bad) < bad else 1 for k in range(n)])
    x[:, 0] += label
    return x, label, spark.createDataFrame([(k, int(y), r.tolist()) for k, (y, r) in enumerate(zip(label, x))], "doc_id long, label int, x array<double>")


@pytest.mark.parametrize("bad", [4, 150])
def test_every_row_is_in_a_pair(spark, bad):
    x, label, rows = _rows(spark, 600, bad)
    counts = {0: bad, 1: 600 - bad}
    blocks = quality.deal(rows, counts, 100).collect()
    seen, own = set(), 0
    for r in blocks:
        b = quality.Block(r.block, np.frombuffer(r.x).reshape(-1, quality.N_FEATURES), np.frombuffer(r.label, np.uint8), np.frombuffer(r.own, bool))
        winner, loser = b.pairs(20, 7)
        assert (b.label[winner] == 1).all() and (b.label[loser] == 0).all()
        seen |= {b.x[k].tobytes() for k in np.concatenate([winner, loser])}
        own += b.own.sum()
    assert len(blocks) == 7 and own == 600 and seen == {r.tobytes() for r in x}


def test_blocks_do_not_change_the_sums(spark):
    x, label, rows = _rows(spark, 600, 150)
    with scratch(spark):
        one, many = quality.fit(rows), quality.fit(rows, block=100)
    for r in (one, many):
        assert np.allclose(r.mean, x.mean(0)) and np.allclose(r.scale, x.std(0) + 1e-6)
        raw = r.raw(x)
        assert r.cut == pytest.approx(np.quantile(raw, 0.25))
        slope, shift = quality._logistic(np.column_stack([raw, np.ones(600)]), label.astype(float), 1e-3)
        assert (r.slope, r.shift) == pytest.approx((slope, shift), rel=1e-6)
    assert np.corrcoef(one.weight, many.weight)[0, 1] > 0.95


def test_values_by_rank(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED_ROWS", 3)
    monkeypatch.setattr(quality, "RANGE_COUNTS", 4)
    x = np.concatenate([np.random.default_rng(1).lognormal(size=200), [2.5] * 50])
    df = spark.createDataFrame([(float(v),) for v in x], "raw double")
    assert [quality.at_rank(df, k) for k in (0, 100, 180, 249)] == [float(np.sort(x)[k]) for k in (0, 100, 180, 249)]
