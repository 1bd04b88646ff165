"""Retrieval sets derived from the driver tables (see FIXTURES.md).

Every fixture reads whole tables; no row is dropped to make a check cheaper.
Ids are strings (X2), relevance judgments use ``(query_id, corpus_id, score)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.operators import containment
from lumenrank.session import stored
from lumenrank.sources.io import RetrievalSet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_set(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """KNOWN: corpus = documents; a query is a benchmark passage (whole text)
    that occurs verbatim in at least one document; those documents are relevant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = stored(containment.pairs(docs, bench), "known-hits")
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    qrels = hits.select(F.col("item_id").cast("string").alias("query_id"),
                        F.col("doc_id").cast("string").alias("corpus_id"),
                        F.lit(1.0).alias("score"))
    queries = (bench.join(hits.select("item_id").distinct(), "item_id", "left_semi")
               .select(F.col("item_id").cast("string").alias("id"), "text"))
    return RetrievalSet(corpus, queries, qrels)


def _as_double(c):
    return F.transform(c, lambda x: x.cast("double"))


def _mean_with_next(e: DataFrame, key: str, vec: str) -> DataFrame:
    """Each vector replaced by the element-wise mean with the vector of
    ``key + 1``; the last one keeps its own vector (double precision)."""
    nxt = e.select((F.col(key) - 1).alias(key), F.col(vec).alias("_next"))
    return (e.join(nxt, key, "left")
            .withColumn("qv", F.when(F.col("_next").isNull(), _as_double(F.col(vec)))
                        .otherwise(F.zip_with(vec, "_next",
                                              lambda x, y: (x.cast("double") + y.cast("double")) / 2.0)))
            .drop("_next"))


def vec_set(spark: SparkSession, sf_dir: str):
    """VEC: corpus = every embedding; query i = mean of vector i and i+1;
    relevant = document i.  Returns (doc_vecs, query_vecs, qrels, n_queries)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    doc_vecs = e.select(F.col("vec_id").cast("string").alias("doc_id"),
                        F.col("embedding").alias("vector"))
    q = _mean_with_next(e, "vec_id", "embedding")
    query_vecs = q.select(F.col("vec_id").cast("string").alias("query_id"), F.col("qv").alias("vector"))
    qrels = e.select(F.col("vec_id").cast("string").alias("query_id"),
                     F.col("vec_id").cast("string").alias("corpus_id"), F.lit(1.0).alias("score"))
    return doc_vecs, query_vecs, qrels


def hyb_vectors(rs: RetrievalSet):
    """HYB: KNOWN texts embedded with the default hashing encoder."""
    from lumenrank.operators import embed

    return embed.embed(rs.corpus), stored(embed.embed(rs.queries, out_id="query_id"), "query-vectors")


def late_vectors(rs: RetrievalSet):
    """LATE: KNOWN texts as token vectors (U3), every document (packed, with its text) and every query."""
    from lumenrank.operators import embed

    # encoding costs far more than sending a text, and a large row group is read by one task
    doc_vecs = embed.embed(rs.corpus.repartition("id", "text"), embed.distinct_token_encoder, multi=True, packed=True, carry=("text",))
    query_vecs = embed.embed(rs.queries, embed.token_hashing_encoder, multi=True, out_id="query_id")
    return doc_vecs, stored(query_vecs, "query-token-vectors")


def tok_set(spark: SparkSession, sf_dir: str):
    """TOK: multi-vector document d = embeddings with vec_id div 4 = d; the
    query of d uses each vector's mean with the next vec_id.
    Returns (doc_vecs, query_vecs)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = _mean_with_next(e, "vec_id", "embedding")
    grp = F.floor(F.col("vec_id") / 4).cast("long")
    doc_vecs = (e.groupBy(grp.alias("d"))
                .agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
                .select(F.col("d").cast("string").alias("doc_id"),
                        F.transform("s", lambda x: x["embedding"]).alias("vectors")))
    query_vecs = (q.groupBy(grp.alias("d"))
                  .agg(F.sort_array(F.collect_list(F.struct("vec_id", "qv"))).alias("s"))
                  .select(F.col("d").cast("string").alias("query_id"),
                          F.transform("s", lambda x: x["qv"]).alias("vectors")))
    return doc_vecs, query_vecs


def dirty_set(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """DIRTY: every documents/labels row, with deterministic defects injected:
    null text where doc_id mod 97 = 5, rows with doc_id mod 101 = 7 repeated,
    queries = labelled documents except doc_id mod 73 = 4 (dangling qrels),
    corpus id shifted by 10,000,000 where doc_id mod 89 = 3, score 'high'
    where mod 83 = 1, 'NaN' where mod 79 = 2, else the quality label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    base = d.select(F.col("doc_id").alias("id"),
                    F.when(F.col("doc_id") % 97 == 5, F.lit(None).cast("string"))
                    .otherwise(F.col("text")).alias("text"))
    corpus = base.unionByName(base.where(F.col("id") % 101 == 7))
    queries = (lab.where(F.col("doc_id") % 73 != 4)
               .join(d, "doc_id").select(F.col("doc_id").alias("id"), "text"))
    qrels = lab.select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("doc_id") % 89 == 3, F.col("doc_id") + 10_000_000)
        .otherwise(F.col("doc_id")).alias("corpus_id"),
        F.when(F.col("doc_id") % 83 == 1, F.lit("high"))
        .when(F.col("doc_id") % 79 == 2, F.lit("NaN"))
        .otherwise(F.col("quality").cast("string")).alias("score"))
    return RetrievalSet(corpus, queries, qrels)


def greedy_set(spark: SparkSession, sf_dir: str):
    """GREEDY: every order is a query whose positives are its distinct parts;
    corpus = part; returns (RetrievalSet, budget = 10 % of the corpus)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    corpus = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"))
    qrels = (li.select(F.col("l_orderkey").cast("string").alias("query_id"),
                       F.col("l_partkey").cast("string").alias("corpus_id")).distinct()
             .withColumn("score", F.lit(1.0)))
    queries = li.select("l_orderkey").distinct().select(F.col("l_orderkey").cast("string").alias("id")).withColumn("text", F.col("id"))
    n = part.count()
    return RetrievalSet(corpus, queries, qrels), max(1, n // 10)


def runs_set(spark: SparkSession, sf_dir: str):
    """RUNS: one evaluation result row per part: project = brand, model = 'm'
    + partkey (or 'BM25' where partkey mod 40 = 0), model_short = type,
    alpha = ((partkey mod 4) + 1) / 4, mrr@10 = retailprice / 2500 (null where
    partkey mod 37 = 0), latency = size, total = size * 1000, 1000 documents.
    Memory: one row per type, 100 x its alphabetical position, the first
    negative, the last missing.  Returns (results, memory)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    bm = F.col("p_partkey") % 40 == 0
    results = p.select(
        F.col("p_brand").alias("project"),
        F.when(bm, F.lit("BM25")).otherwise(F.concat(F.lit("m"), F.col("p_partkey").cast("string"))).alias("model"),
        F.when(bm, F.lit("BM25")).otherwise(F.col("p_type")).alias("model_short"),
        F.when(bm, F.lit(0.0)).otherwise(((F.col("p_partkey") % 4) + 1) / 4.0).alias("alpha"),
        F.when(F.col("p_partkey") % 37 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_retailprice") / 2500.0).alias("mrr@10"),
        F.when(bm, F.lit(0.0)).otherwise(F.col("p_size").cast("double")).alias("avg_embed_time_ms"),
        F.when(bm, F.lit(0.0)).otherwise(F.col("p_size") * 1000.0).alias("total_embed_time_ms"),
        F.lit(1000).cast("long").alias("num_documents"),
        F.col("p_partkey"))
    types = p.select("p_type").distinct()
    # a handful of distinct types: ranking them needs no partitioning
    ranked = types.withColumn("pos", F.dense_rank().over(Window.orderBy("p_type")))
    n = types.count()
    memory = (ranked.where(F.col("pos") < n)
              .select(F.col("p_type").alias("model_short"),
                      F.when(F.col("pos") == 1, F.col("pos") * -100.0)
                      .otherwise(F.col("pos") * 100.0).alias("peak_memory_mb")))
    return results, memory


TASK_TYPES = ["Retrieval", "InstructionRetrieval", "Any2AnyRetrieval",
              "Any2AnyMultilingualRetrieval", "Reranking"]
VERSIONS = ["v1", "v2", "v3", "classic"]


def catalog_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CATALOG: one task record per document: path = source, language = lang,
    task = lang-(doc_id mod 7), revision r(doc_id mod 3), type by doc_id mod 5,
    version by doc_id mod 4."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    types = F.array(*[F.lit(t) for t in TASK_TYPES])
    vers = F.array(*[F.lit(v) for v in VERSIONS])
    return d.select(
        F.col("source").alias("path"), F.col("lang"),
        F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("task_name"),
        F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("revision"),
        F.element_at(types, (F.col("doc_id") % 5 + 1).cast("int")).alias("task_type"),
        F.element_at(vers, (F.col("doc_id") % 4 + 1).cast("int")).alias("version"))


def name_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """NAMES: benchmarks of some of the (language, version) pairs of CATALOG, alias ``lang-version``;
    requests by bare language, with and without a version, and by alias.  Returns (requests, benchmarks)."""
    from lumenrank.operators import catalog

    t = catalog_tasks(spark, sf_dir).select("lang", "version").distinct()
    there = (F.ascii("lang") + F.ascii(F.substring("version", 2, 1))) % 3 != 0
    benchmarks = t.where(there).select(
        F.concat(F.lit("MTEB("), catalog.normalise_lang(F.col("lang")), F.lit(", "), F.col("version"), F.lit(")")).alias("name"),
        F.concat_ws("-", "lang", "version").alias("alias"))
    asked = F.array(F.col("lang"), F.concat(F.lit("MTEB("), "lang", F.lit(")")),
                    F.concat(F.lit("MTEB("), "lang", F.lit(", "), "version", F.lit(")")), F.concat_ws("-", "lang", "version"))
    return t.select(F.explode(asked).alias("user_value")).distinct(), benchmarks


def metric_rows(results: DataFrame) -> DataFrame:
    """METRICS: long rows of RUNS: an MRR at cutoff 5 to 20 by type, a Hit Rate at 1 to 7 by part, some other metric."""
    k = F.length("model_short") % 4
    rows = F.array(
        F.when((k > 0) & F.col("mrr@10").isNotNull(), F.struct(F.lit("mrr").alias("metric"), (k * 5).cast("long").alias("k"))),
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit("hit_rate").alias("metric"), (F.col("p_partkey") % 7 + 1).alias("k"))),
        F.struct(F.lit("recall").alias("metric"), F.lit(100).cast("long").alias("k")))
    return results.select("project", F.col("avg_embed_time_ms").alias("latency"), F.explode(rows).alias("_m")).where(
        "_m is not null").select("project", "latency", "_m.*")


def catalog_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs per (source, lang): corpus always, queries when any doc_id is
    even, qrels when any document is labelled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    g = (d.join(lab, "doc_id", "left").groupBy("source", "lang")
         .agg(F.max(F.col("doc_id") % 2 == 0).alias("has_even"),
              F.max(F.coalesce("labelled", F.lit(False))).alias("has_label")))
    roles = F.array(F.lit("corpus"), F.when(F.col("has_even"), F.lit("queries")),
                    F.when(F.col("has_label"), F.lit("qrels")))
    return (g.select(F.col("source").alias("dataset"), "lang", F.explode(roles).alias("role"))
            .where(F.col("role").isNotNull())
            .select("dataset", F.concat(F.col("lang"), F.lit("-"), F.col("role")).alias("config")))


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.select("doc_id", "lang", F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("dataset"))


def config_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """CONFIGS: data sets (source, doc_id mod 40) with language configurations, roles left out
    by doc_id, and standard ones (lang, doc_id mod 6); requests with none, own and unknown languages."""
    k = _datasets(spark, sf_dir)
    of, i = F.concat("lang", F.lit("/"), (F.col("doc_id") % 6).cast("string")), F.col("doc_id")

    def named(where, dataset, config):
        return k.where(where).select(dataset.alias("dataset"), config.alias("config"))

    every, own = F.lit(True), F.col("dataset")
    parts = [named(every, own, F.concat("lang", F.lit("-corpus"))), named(i % 5 != 0, own, F.concat("lang", F.lit("-queries"))),
             named(i % 7 != 0, own, F.concat("lang", F.lit("-qrels"))), named(every, of, F.lit("corpus")),
             named(i % 6 != 1, of, F.lit("queries")), named(i % 6 == 2, of, F.lit("qrels")),
             named((i % 6).isin(2, 3), of, F.lit("default"))]
    configs = reduce(DataFrame.unionByName, parts).distinct()
    asked = [configs.select("dataset", F.lit(None).cast("string").alias("language")), k.select("dataset", F.col("lang").alias("language")),
             k.where(i % 2 == 0).select(of.alias("dataset"), F.col("lang").alias("language")),
             k.where(i % 3 == 0).select("dataset", F.lit("xx").alias("language"))]
    return configs, reduce(DataFrame.unionByName, asked).distinct()


def split_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """SPLITS: data sets (source, doc_id mod 40) whose roles have splits named by language or
    by role, some none; requests without a split, for own ones and for 'test'."""
    k, i = _datasets(spark, sf_dir), F.col("doc_id")
    role = lambda where, name, split: k.where(where).select("dataset", F.lit(name).alias("role"), split.alias("split"))
    splits = (role(i % 11 != 0, "corpus", F.when(i % 3 == 0, F.lit("corpus")).otherwise(F.col("lang")))
              .unionByName(role(i % 13 != 0, "queries", F.when(i % 4 == 0, F.lit("queries")).otherwise(F.col("lang"))))
              .unionByName(role(i % 17 != 0, "qrels", F.col("lang")))).distinct()
    asked = [k.select("dataset", F.lit(None).cast("string").alias("split")), k.where(i % 2 == 0).select("dataset", F.col("lang").alias("split")),
             k.where(i % 19 == 0).select("dataset", F.lit("test").alias("split"))]
    return splits, reduce(DataFrame.unionByName, asked).distinct()
