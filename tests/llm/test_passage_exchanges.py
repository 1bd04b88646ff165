"""What passages exchange: texts meet their lists by one plan at every size, a passage's sums need no exchange of rows."""

import random

from lumenrank.llm import passages
from lumenrank.llm.tables import documents
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_not_broadcast_however_few(spark):
    docs = documents(spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e")], "doc_id long, text string")).withColumn(
        "text_key", F.xxhash64("text"))
    lists = docs.where("doc_id < 3").select("doc_id", "text_key", F.array(F.lit(7)).alias("beside"))
    found = passages._listed(docs, lists, "beside")
    assert _plan(found).count("BroadcastHashJoin") == 1         # the ids alone, which leave out other texts
    assert sorted((r.doc_id, r.text, r.beside) for r in found.collect()) == [(1, "a b", [7]), (2, "c d", [7])]


def test_words_of_a_passage_without_another_exchange(spark):
    rnd = random.Random(5)

    def loose(n):
        return " ".join(f"w{rnd.randrange(10 ** 9)}" for _ in range(n))

    passage = loose(70)
    rows = [(i, f"{loose(40)} {passage} {loose(40)}") for i in (1, 2, 3)]
    rows += [rows[1], (4, loose(90))]       # one row twice
    out = passages.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = _plan(out)
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 2
    got = out.collect()
    assert {r.doc_id for r in got} == {1, 2, 3}
    for doc in (1, 2, 3):
        own = [r for r in got if r.doc_id == doc]
        parts = {(r.start, r.end, r.n_words) for r in own}
        assert len(own) == len(parts) * (2 if doc == 2 else 1)
        assert {r.passage_words for r in own} == {sum(n for *_, n in parts)} and 68 <= own[0].passage_words <= 70
