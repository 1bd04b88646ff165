"""Configurations, splits, ordered exports, versioned vectors, result reuse, radix selection."""
import csv
import hashlib
import json
import os
import random
import tempfile

import pytest

from lumenrank.operators import configs, lexical, sampling
from lumenrank.sources import sinks, stores


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_layouts(spark):
    names = {"many": ["fr-corpus", "fr-queries", "fr-qrels", "it-corpus", "it-queries", "draft-corpus"],
             "plain": ["corpus", "queries", "fr-corpus", "fr-queries", "fr-qrels"],
             "inner": ["x-corpus-v1", "x-v1-queries", "x-v1-qrels"], "none": ["default"]}
    df = table(spark, [(d, c) for d, cs in names.items() for c in cs], "dataset string, config string")
    got = {r.dataset: (r.standard, r.languages) for r in configs.layouts(df).collect()}
    assert got == {"many": (False, ["fr"]), "plain": (True, []), "inner": (False, ["x-v1"]), "none": (False, [])}


@pytest.mark.parametrize("names,language,want", [
    (["corpus", "queries", "qrels"], None, (None, "corpus", "queries", "qrels", None, [])),
    (["corpus", "queries", "default"], None, (None, "corpus", "queries", "default", None, [])),
    (["corpus", "queries", "qrels", "default"], None, (None, "corpus", "queries", "qrels", None, [])),
    (["corpus", "queries"], None, (None, None, None, None, "qrels_missing", [])),
    (["corpus", "queries", "qrels"], "fr", (None, None, None, None, "language_refused", [])),
    (["fr-corpus", "fr-queries", "fr-qrels"], "fr", ("fr", "fr-corpus", "fr-queries", "fr-qrels", None, [])),
    (["fr-corpus", "fr-queries", "fr-qrels", "it-corpus"], None, ("fr", "fr-corpus", "fr-queries", "fr-qrels", None, [])),
    (["it-corpus", "it-queries", "it-qrels", "fr-corpus", "fr-queries", "fr-qrels"], None,
     (None, None, None, None, "language_needed", ["fr", "it"])),
    (["it-corpus", "it-queries", "it-qrels"], "fr", (None, None, None, None, "language_unknown", ["it"])),
    (["it-corpus", "it-queries"], None, (None, None, None, None, "incomplete", [])),
    (["x-corpus-v1", "x-v1-queries", "x-v1-qrels"], None, (None, None, None, None, "incomplete", []))])
def test_config_resolution(spark, names, language, want):
    got = configs.resolve(table(spark, [("d", c) for c in names], "dataset string, config string"),
                          table(spark, [("d", language)], "dataset string, language string"))
    row = got.collect()
    assert [tuple(r)[2:] for r in row] == [want]
    if want[4]:
        with pytest.raises(ValueError, match=want[4]):
            configs.raise_errors(got)


@pytest.mark.parametrize("corpus,queries,qrels,split,want", [
    (["corpus"], ["dev", "test"], ["dev", "test"], "test", ("test", "test", "corpus", None, [])),
    (["corpus"], ["queries"], ["dev"], None, ("dev", "queries", "corpus", None, [])),
    (["dev", "test"], ["queries", "dev"], ["dev"], None, ("dev", "dev", "dev", None, [])),
    (["all"], ["queries"], ["dev"], "dev", ("dev", "queries", "all", None, [])),
    (["corpus"], ["queries"], ["dev", "test"], None, (None, None, None, "split_needed", ["dev", "test"])),
    (["corpus"], ["queries"], ["dev"], "test", (None, None, None, "split_unknown", ["dev"])),
    (["corpus"], ["test"], ["dev"], None, (None, None, None, "queries_unmatched", ["test"])),
    (["a", "b"], ["queries"], ["dev"], None, (None, None, None, "corpus_ambiguous", ["a", "b"])),
    ([], ["queries"], ["dev"], None, (None, None, None, "corpus_missing", [])),
    (["corpus"], [], ["dev"], None, (None, None, None, "queries_missing", [])),
    (["corpus"], ["queries"], [], "dev", (None, None, None, "qrels_missing", []))])
def test_split_matching(spark, corpus, queries, qrels, split, want):
    rows = [("d", role, s) for role, names in (("corpus", corpus), ("queries", queries), ("qrels", qrels)) for s in names]
    got = configs.match_splits(table(spark, rows, "dataset string, role string, split string"),
                               table(spark, [("d", split)], "dataset string, split string")).collect()
    assert [tuple(r)[2:] for r in got] == [want]


def test_results_csv(spark):
    path = tempfile.mkdtemp(prefix="lr-sink-") + "/out.csv"
    rows = [(i, {"name": f'a "{i}", b', **({"late": str(i)} if i == 50 else {}), "value": str(i * 2)}) for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "at int, values map<string,string>").repartition(7)
    assert sinks.write_results_csv(df, path, ["at"]) == ["name", "value", "late"]
    with open(path, newline="") as f:
        back = list(csv.DictReader(f))
    assert [(r["name"], r["value"], r["late"]) for r in back] == [(f'a "{i}", b', str(2 * i), "50" if i == 50 else "") for i in range(200)]
    assert os.listdir(os.path.dirname(path)) == ["out.csv"] or set(os.listdir(os.path.dirname(path))) <= {"out.csv", ".out.csv.crc"}


def test_catalog_exports(spark):
    root = tempfile.mkdtemp(prefix="lr-sink-")
    df = spark.createDataFrame([("b", "r1", ["x"]), ("a", "r2", ["u", "v"])], "dataset_path string, dataset_revision string, tasks array<string>")
    want = {"json": ['{"dataset_path":"a","dataset_revision":"r2","tasks":["u","v"]}', '{"dataset_path":"b","dataset_revision":"r1","tasks":["x"]}'],
            "csv": ["dataset_path,dataset_revision,tasks", "a,r2,u;v", "b,r1,x"], "text": ["a\tr2\tu, v", "b\tr1\tx"]}
    for kind, lines in want.items():
        assert sinks.write_catalog(df, f"{root}/{kind}", kind)
        assert open(f"{root}/{kind}").read() == "\n".join(lines) + "\n"
        assert not sinks.write_catalog(df.limit(0), f"{root}/{kind}", kind)       # replaces the former file
        assert open(f"{root}/{kind}").read() == ""
    with pytest.raises(ValueError):
        sinks.write_catalog(df, f"{root}/x", "xml")


def test_manifest(spark):
    path = tempfile.mkdtemp(prefix="lr-sink-") + "/manifest.json"
    stats = spark.createDataFrame([(7, 0.5)], "seed long, coverage double")
    sinks.write_manifest(stats, path, {"dataset": "é", "splits": {"qrels": "test", "corpus": "corpus"}})
    text = open(path, encoding="utf-8").read()
    assert json.loads(text) == {"dataset": "é", "splits": {"corpus": "corpus", "qrels": "test"}, "schema_version": 1,
                                "sampling": {"seed": 7, "coverage": 0.5}}
    assert text.index('"dataset"') < text.index('"sampling"') < text.index('"schema_version"') < text.index('"splits"')
    with pytest.raises(ValueError):
        sinks.write_manifest(stats.union(stats), path, {})


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, vector array<double>")


def test_versioned_vectors(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="lr-versions-")
    store = stores.VectorStore(spark, root)
    staged = store.stage(vectors(spark, ("a", [1.0])), "k", {"model": "m", "dim": 1})
    assert staged.count() == 1 and not store.exists("k")
    with pytest.raises(FileNotFoundError):
        store.load("k")
    store.commit()
    reader = stores.VectorStore(spark, root)
    assert [r.vector for r in reader.load("k").collect()] == [[1.0]] and reader.metadata("k") == {"model": "m", "dim": 1}
    # a run that ends in the middle of a commit leaves the former version
    broken = stores.VectorStore(spark, root)
    broken.stage(vectors(spark, ("a", [2.0])), "k", {"model": "n"})
    broken.stage(vectors(spark, ("b", [3.0])), "other")
    with monkeypatch.context() as m:
        def crash(*a):
            raise OSError("lost")
        m.setattr(stores.sinks, "write_text", crash)
        with pytest.raises(OSError):
            broken.commit()
    assert [r.vector for r in reader.load("k").collect()] == [[1.0]] and not reader.exists("other")
    broken.discard()
    assert [r.vector for r in reader.load("k").collect()] == [[1.0]]
    assert len(os.listdir(f"{root}/versions")) == 1
    again = stores.VectorStore(spark, root)
    again.stage(vectors(spark, ("a", [4.0])), "k", {"model": "o"})
    again.commit()
    assert [r.vector for r in reader.load("k").collect()] == [[4.0]] and reader.metadata("k") == {"model": "o"}
    assert len(os.listdir(f"{root}/versions")) == 1


def test_results_are_reused_under_new_labels(spark):
    root = tempfile.mkdtemp(prefix="lr-results-")
    schema = "eval_key string, model_short string, value double"
    stores.save_results(spark.createDataFrame([("e1", "old", 0.5), ("e2", "same", 0.7), ("e3", "x", 0.9)], schema), root)
    grid = spark.createDataFrame([("e1", "new"), ("e2", "same"), ("e9", "y")], "eval_key string, model_short string")
    got = sorted((r.eval_key, r.model_short, r.value) for r in stores.reuse_results(spark, root, grid).collect())
    assert got == [("e1", "new", 0.5), ("e2", "same", 0.7)]
    assert spark.read.parquet(root).count() == 3
    assert stores.load_results(spark, root + "/none", grid).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 500, 4999, 5000, 9000])
def test_radix_selection(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "TAIL_ROWS", 3)
    monkeypatch.setattr(sampling, "RADIX_HEX", 1)
    ids = [f"d{i}" for i in range(5000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    chosen = sampling.first_n(df, "id", 3, n)
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:3".encode()).hexdigest(), i))
    assert sorted(r.id for r in chosen.collect()) == sorted(order[:n])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=%d," % n not in plan or n <= 3


def test_index_completeness(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "")], "id string, text string")
    assert lexical.build_index(docs).n_docs == 3
    assert lexical.build_index(docs.limit(0)).n_docs == 0
    with pytest.raises(ValueError, match="2 of 3"):
        lexical.check_complete(3, 2)


def test_index_with_a_failed_row(spark):
    bad = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [1.0, 2.0])], "id string, text string, vector array<double>")
    from pyspark.sql import functions as F

    poisoned = bad.withColumn("text", F.when(F.col("id") == "b", F.raise_error(F.lit("unreadable"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="unreadable"):
        lexical.build_index(poisoned)
