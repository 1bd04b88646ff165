"""One violations DataFrame per retrieval set, plus a raising wrapper.

``violations`` returns ``(table_name, rule, n, sample_id)`` with one row per
rule (``n = 0`` and a null sample when the rule holds).  All counts of a table
come from a single aggregation pass; referential rules are anti joins.  The
sample id is the smallest offending id (Spark has no row order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.sources.io import RetrievalSet

REQUIRED = {"corpus": ("id", "text"), "queries": ("id", "text"),
            "qrels": ("query_id", "corpus_id")}


def normalise_id_column(df: DataFrame) -> DataFrame:
    """``_id`` is the id column when present (preferred over ``id``)."""
    if "_id" in df.columns:
        return (df.drop("id") if "id" in df.columns else df).withColumnRenamed("_id", "id")
    if "id" not in df.columns:
        raise ValueError("table needs an 'id' or '_id' column")
    return df


def check_columns(rs: RetrievalSet) -> None:
    """V1: required columns, checked on the schema (no job)."""
    for name, cols in REQUIRED.items():
        df = getattr(rs, name)
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"{name} is missing required columns: {missing}")


def score_column(qrels: DataFrame) -> Column:
    """V7 + V8 coercion: missing column -> 1.0; unparsable -> null (ANSI-safe)."""
    if "score" not in qrels.columns:
        return F.lit(1.0)
    return F.col("score").cast("string").try_cast("double")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _rule(table: str, rule: str, n: Column, sample: Column):
    return F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                    n.cast("long").alias("n"), sample.cast("string").alias("sample_id"))


def _id_table_rules(df: DataFrame, table: str) -> DataFrame:
    sid = F.col("id").cast("string")
    bad_text = F.col("text").isNull()
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_text).alias("text_n"), F.min(F.when(bad_text, sid)).alias("text_s"),
        F.count_if(F.col("id").isNull()).alias("idnull_n"))
    dups = (df.where(F.col("id").isNotNull()).groupBy(sid.alias("sid")).count()
            .where("count > 1").agg(F.count(F.lit(1)).alias("dup_n"), F.min("sid").alias("dup_s")))
    rows = base.select(F.explode(F.array(
        _rule(table, "not_empty", F.when(F.col("rows") == 0, 1).otherwise(0), F.lit(None)),
        _rule(table, "text_present", F.col("text_n"), F.col("text_s")),
        _rule(table, "id_not_null", F.col("idnull_n"), F.lit(None)),
    )).alias("r")).select("r.*")
    return rows.unionByName(dups.select(_rule(table, "id_unique", F.col("dup_n"), F.col("dup_s"))
                                        .alias("r")).select("r.*"))


def violations(rs: RetrievalSet) -> DataFrame:
    """V2-V10 as rows ``(table_name, rule, n, sample_id)``."""
    check_columns(rs)
    corpus = rs.corpus.select("id", "text")
    queries = rs.queries.select("id", "text")
    q = rs.qrels.select(F.col("query_id").cast("string").alias("query_id"),
                        F.col("corpus_id").cast("string").alias("corpus_id"),
                        score_column(rs.qrels).alias("score"))
    cids = corpus.select(F.col("id").cast("string").alias("corpus_id")).distinct()
    qids = queries.select(F.col("id").cast("string").alias("query_id")).distinct()
    bad_score = ~_finite(F.col("score"))
    qagg = q.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("query_id").isNull()).alias("qnull"),
        F.count_if(F.col("corpus_id").isNull()).alias("cnull"),
        F.count_if(bad_score).alias("score_n"),
        F.min(F.when(bad_score, F.col("query_id"))).alias("score_s"))
    dq = (q.where(F.col("query_id").isNotNull()).join(qids, "query_id", "left_anti")
          .agg(F.count(F.lit(1)).alias("dq_n"), F.min("query_id").alias("dq_s")))
    dc = (q.where(F.col("corpus_id").isNotNull()).join(cids, "corpus_id", "left_anti")
          .agg(F.count(F.lit(1)).alias("dc_n"), F.min("corpus_id").alias("dc_s")))
    pos = q.where(_finite(F.col("score")) & (F.col("score") > 0)).select("query_id").distinct()
    nopos = (qids.join(pos, "query_id", "left_anti")
             .agg(F.count(F.lit(1)).alias("np_n"), F.min("query_id").alias("np_s")))
    def one(df, table, rule, n, sample):
        return df.select(_rule(table, rule, F.col(n), F.col(sample)).alias("r")).select("r.*")

    qr = qagg.select(F.explode(F.array(
        _rule("qrels", "not_empty", F.when(F.col("rows") == 0, 1).otherwise(0), F.lit(None)),
        _rule("qrels", "query_id_not_null", F.col("qnull"), F.lit(None)),
        _rule("qrels", "corpus_id_not_null", F.col("cnull"), F.lit(None)),
        _rule("qrels", "score_finite", F.col("score_n"), F.col("score_s")),
    )).alias("r")).select("r.*")
    qr = (qr.unionByName(one(dq, "qrels", "query_id_exists", "dq_n", "dq_s"))
          .unionByName(one(dc, "qrels", "corpus_id_exists", "dc_n", "dc_s"))
          .unionByName(one(nopos, "queries", "has_positive", "np_n", "np_s")))
    return _id_table_rules(corpus, "corpus").unionByName(
        _id_table_rules(queries, "queries")).unionByName(qr)


def normalised(rs: RetrievalSet) -> RetrievalSet:
    """X2 + V7 + V8 coercion (no checks): string ids, double score."""
    corpus = normalise_id_column(rs.corpus).withColumn("id", F.col("id").cast("string"))
    queries = normalise_id_column(rs.queries).withColumn("id", F.col("id").cast("string"))
    qrels = rs.qrels.select(F.col("query_id").cast("string").alias("query_id"),
                            F.col("corpus_id").cast("string").alias("corpus_id"),
                            score_column(rs.qrels).alias("score"),
                            *[c for c in rs.qrels.columns if c not in ("query_id", "corpus_id", "score")])
    return RetrievalSet(corpus, queries, qrels)


def _fail_on_first(found: DataFrame) -> None:
    bad = found.where("n > 0").orderBy("table_name", "rule").limit(1).collect()
    if bad:
        b = bad[0]
        raise ValueError(f"{b.table_name}: rule {b.rule} violated by {b.n} row(s), "
                         f"e.g. id {b.sample_id}")


def validated(rs: RetrievalSet) -> RetrievalSet:
    """Raising wrapper: normalise, then fail on the first violated rule."""
    rs = normalised(rs)
    _fail_on_first(violations(rs))
    return rs


def prepared(rs: RetrievalSet) -> RetrievalSet:
    """V1-V12 for a set whose query table may serve several splits: every rule must hold,
    but queries without any judgment need no relevant document and are left out."""
    rs = normalised(rs)
    judged = rs.qrels.select(F.col("query_id").alias("id"))
    bank = RetrievalSet(rs.corpus, rs.queries.join(judged, "id", "left_semi"), rs.qrels)
    positive = F.col("rule") == "has_positive"
    _fail_on_first(violations(rs).where(~positive).unionByName(violations(bank).where(positive)))
    return bank


def _usable(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def rejected_rows(rs: RetrievalSet) -> DataFrame:
    """What ``clean`` leaves out: (table_name, rule, query_id, corpus_id, n).

    A corpus row is named by its id; ``n`` counts its rows (for ``id_unique``, those
    beyond the one that stays).  A judgment has the first rule that it breaks, in the
    order score, document, query; a document or query without text does not exist for it.
    A query has the rule ``has_judgment`` if no judgment of it is left.
    """
    rs = normalised(rs)
    none = F.lit(None).cast("string")
    bad = F.when(F.col("id").isNull(), F.lit("id_not_null")).when(F.col("text").isNull(), F.lit("text_present"))

    def of_table(table: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Broken rows (rule, id, n), and the usable ids with their numbers of rows."""
        broken = (table.select("id", bad.alias("rule")).where(F.col("rule").isNotNull())
                  .groupBy("rule", "id").agg(F.count(F.lit(1)).alias("n")))
        usable = _usable(table).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return broken.unionByName(usable.where("n > 1").select(
            F.lit("id_unique").alias("rule"), "id", (F.col("n") - 1).alias("n"))), usable

    broken, usable = of_table(rs.corpus)
    corpus = broken.select(F.lit("corpus").alias("table_name"), "rule", none.alias("query_id"), F.col("id").alias("corpus_id"), "n")
    broken, usable_queries = of_table(rs.queries)
    judged = clean(rs).qrels.select(F.col("query_id").alias("id"))
    idle = (usable_queries.join(judged, "id", "left_anti")
            .select(F.lit("has_judgment").alias("rule"), "id", F.lit(1).cast("long").alias("n")))
    queries = broken.unionByName(idle).select(F.lit("queries").alias("table_name"), "rule", F.col("id").alias("query_id"),
                                              none.alias("corpus_id"), "n")
    there = usable.select(F.col("id").alias("corpus_id"), F.lit(True).alias("_c"))
    asked = usable_queries.select(F.col("id").alias("query_id"), F.lit(True).alias("_q"))
    rule = (F.when(~_finite(F.col("score")), F.lit("score_finite")).when(F.col("_c").isNull(), F.lit("corpus_id_exists"))
            .when(F.col("_q").isNull(), F.lit("query_id_exists")))
    qrels = rs.qrels.select("query_id", "corpus_id", "score").join(there, "corpus_id", "left").join(asked, "query_id", "left")
    return corpus.unionByName(queries).unionByName(qrels.select(F.lit("qrels").alias("table_name"), rule.alias("rule"), "query_id", "corpus_id",
                                           F.lit(1).cast("long").alias("n")).where(F.col("rule").isNotNull()))


def clean(rs: RetrievalSet) -> RetrievalSet:
    """Coerce and keep what the rules allow: finite scores, both ends resolved,
    queries restricted to those with a judgment (V12 / J3).  ``rejected_rows`` lists the rest."""
    rs = normalised(rs)
    def one_of_each(table: DataFrame) -> DataFrame:
        """The smallest of several rows of an id, not an arbitrary one."""
        rest = [c for c in table.columns if c not in ("id", "text")]
        return _usable(table).groupBy("id").agg(F.min(F.struct("text", *rest)).alias("_r")).select("id", "_r.*")

    corpus, asked = one_of_each(rs.corpus), one_of_each(rs.queries)
    qrels = (rs.qrels.where(_finite(F.col("score")))
             .join(corpus.select(F.col("id").alias("corpus_id")), "corpus_id", "left_semi")
             .join(asked.select(F.col("id").alias("query_id")), "query_id", "left_semi"))
    queries = asked.join(qrels.select(F.col("query_id").alias("id")), "id", "left_semi")
    return RetrievalSet(corpus, queries, qrels)
