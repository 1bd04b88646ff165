"""Messy and empty tables, learned operators on held-out rows, the pipeline."""
import os
import sys

import duckdb
import pytest
from conftest import SF

from lumenrank.llm import (decontaminate, fingerprints, language_model, near_duplicates, packing, passages, quality,
                           secrets, toxicity)

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
LABELS = "doc_id long, quality int, toxic int"


def operators(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = spark.createDataFrame([], LABELS)
    return {
        "language_model": lambda: language_model.score(docs, language_model.train(docs.select("doc_id", docs["text"]))),
        "packing": lambda: packing.pack(docs),
        "passages": lambda: passages.repeated_paragraphs(docs),
        "decontaminate": lambda: decontaminate.contamination(docs, items),
        "quality": lambda: quality.add_scores(docs.select("doc_id", "text"), quality.train(docs, none)),
        "secrets": lambda: secrets.find_secrets(docs),
        "near": lambda: near_duplicates.near_duplicates(docs),
        "toxicity": lambda: toxicity.tag(docs, toxicity.train(docs, none)),
        "fingerprints": lambda: fingerprints.with_fingerprints(docs)}


NAMES = ["language_model", "packing", "passages", "decontaminate", "quality", "secrets", "near", "toxicity", "fingerprints"]


@pytest.fixture(scope="module")
def plain(messy):
    """The messy rows without the second spelling of ``text``."""
    from lumenrank.llm.tables import documents

    return documents(messy)


@pytest.mark.parametrize("name", NAMES)
def test_messy(spark, messy, plain, name):
    source = plain if name in ("language_model", "quality") else messy
    rows = operators(spark, source)[name]().collect()
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    if name == "passages":
        assert rows == []
    elif name == "packing":
        assert set(ids) == set(range(1, 11)) and sum(r.length for r in rows if r.doc_id == 8) == 50_001
    else:
        assert ids == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10] and len(rows) == 12
    if name == "near":
        by = {r.doc_id: r.component_id for r in rows}
        assert by[4] == 3 and by[10] == 5 and by[1] == 1 and by[2] == 2 and by[None] is None


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, plain, name):
    assert operators(spark, plain.where("doc_id = -5"))[name]().collect() == []


@pytest.mark.parametrize("name,column", [("quality", "quality"), ("toxicity", "toxic")])
def test_held_out(spark, name, column):
    from lumenrank.llm.registry import QUERIES

    query = next(f for k, f in QUERIES.items() if name in k)
    rows = query(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r[column] for r in rows)
    assert len(rows) > 50 and wrong <= (0 if name == "quality" else 0.12 * len(rows))


@pytest.mark.parametrize("key", ["op4_benchmark_decontamination", "op7_chat_formatting", "op8_near_duplicates"])
def test_sql(spark, key):
    from lumenrank.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    rel = con.execute(ORACLE_SQL[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        before = {r.doc_id: r.text for r in kept.collect()}
        assert set(rows) <= set(before) and len(rows) > 0.5 * len(before)
        if name == "near_duplicates":
            sets = {}
            for i, t in before.items():
                w = (t or "").encode().lower().split()
                sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}
            near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert all(any(near(i, j) for j in before if j != i) for i in set(before) - set(rows))
            assert not any(near(i, j) for i in rows for j in rows if i < j)
        if name == "secrets":
            assert all(secrets.scan(r.text) == [] and r.n_chars == len(r.text) for r in rows.values())
            assert all(r.text == texts[i] for i, r in rows.items() if not secrets.scan(texts[i]))
        kept = spark.createDataFrame(after.collect(), docs.schema)
    want = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in p.run(spark, SF).collect()} == want


def test_quality_stage_cuts_at_the_quantile(spark, monkeypatch):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranker = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    raw = {r.doc_id: r._raw for r in quality.add_scores(docs, ranker).collect()}
    cut = sorted(raw.values())[len(raw) // 2]
    monkeypatch.setattr(quality, "train", lambda *a: ranker._replace(cut=cut))
    assert {r.doc_id for r in p.quality_stage(spark, docs, SF).collect()} == {i for i, x in raw.items() if x >= cut}
