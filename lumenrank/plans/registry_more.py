"""Further query keys: dense, hybrid, late interaction, encoders."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.operators import embed, fusion, lexical, metrics
from lumenrank.plans import fixtures
from lumenrank.session import stored
from lumenrank.plans.registry import METRIC_COLS, register, round_metrics

HASH_MODEL = "hashing-64"
TOKEN_MODEL = "token-hashing-16"
VEC_MODEL = "embeddings"
HYBRID_ALPHAS = (0.25, 0.5, 0.75, 1.0)


def _grid_metrics(spark, ranked: DataFrame, qrels: DataFrame, n_queries: int, n_docs: int,
                  alphas, model: str, baseline_label: str | None = "BM25") -> DataFrame:
    runs = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    m = metrics.compute_metrics(ranked, qrels, n_queries, runs=runs, run_cols=["alpha"])
    label = F.lit(model) if baseline_label is None else \
        F.when(F.col("alpha") == 0.0, F.lit(baseline_label)).otherwise(F.lit(model))
    out = m.select(label.alias("model"), "*",
                   F.lit(n_queries).cast("long").alias("num_queries"),
                   F.lit(n_docs).cast("long").alias("num_documents"))
    return round_metrics(out, METRIC_COLS)


@register("dense_topk")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 + R4 + R9: exact dot-product top 10 per query vector."""
    doc_vecs, query_vecs, _ = fixtures.vec_set(spark, sf_dir)
    return fusion.semantic_ranking(doc_vecs, query_vecs, 10).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register("dense_metrics")
def dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 + M5: MRR / Hit Rate of the dense ranking."""
    doc_vecs, query_vecs, qrels = fixtures.vec_set(spark, sf_dir)
    n_q, n_d = query_vecs.count(), doc_vecs.count()
    ranked = fusion.semantic_ranking(doc_vecs, query_vecs, 10).withColumn("alpha", F.lit(1.0))
    return _grid_metrics(spark, ranked, qrels, n_q, n_d, [1.0], VEC_MODEL, None)


def _hyb(spark, sf_dir):
    rs = fixtures.known_set(spark, sf_dir)
    rs.queries = stored(rs.queries, "queries")
    doc_vecs, query_vecs = fixtures.hyb_vectors(rs)
    return rs, lexical.build_index(rs.corpus, vectors=doc_vecs), query_vecs


@register("hybrid_topk")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha 0.5 fusion of BM25 and hashed dense scores, top 10."""
    rs, idx, qv = _hyb(spark, sf_dir)
    r = fusion.hybrid_ranking(idx, rs.queries, qv, alphas=[0.5], max_k=10)
    return r.select("alpha", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register("hybrid_alpha_metrics")
def hybrid_alpha_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + R10 + R13 + M5: the whole alpha grid and the BM25 row in one job."""
    rs, idx, qv = _hyb(spark, sf_dir)
    alphas = (0.0,) + HYBRID_ALPHAS
    ranked = fusion.hybrid_ranking(idx, rs.queries, qv, alphas=alphas, max_k=10)
    return _grid_metrics(spark, ranked, rs.qrels, rs.queries.count(), idx.n_docs, alphas, HASH_MODEL)


@register("minmax_scores")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 + R11: all BM25 matches min-max normalised per query."""
    rs = fixtures.known_set(spark, sf_dir)
    idx = lexical.build_index(rs.corpus)
    n = fusion.lexical_matches(idx, rs.queries)
    return n.select("query_id", "doc_id", "score", F.round("norm", 9).alias("norm"))


@register("maxsim_topk")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 + J6: late-interaction MaxSim over every query-document pair, top 10."""
    dv, qv = fixtures.tok_set(spark, sf_dir)
    return fusion.semantic_ranking(dv, qv, 10, kind="maxsim").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register("late_hybrid_metrics")
def late_hybrid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 + U3: token vectors of every document; MaxSim alone (alpha 1), BM25 (alpha 0), fused in between."""
    rs = fixtures.known_set(spark, sf_dir)
    rs.queries = stored(rs.queries, "queries")
    dv, qv = fixtures.late_vectors(rs)
    idx = lexical.build_index(dv, "doc_id", vectors=dv, vector_col="vectors")
    alphas = (0.0, 0.25, 0.5, 0.75, 1.0)
    ranked = fusion.hybrid_ranking(idx, rs.queries, qv, alphas=alphas, max_k=10, kind="maxsim")
    return _grid_metrics(spark, ranked, rs.qrels, rs.queries.count(), idx.n_docs, alphas, TOKEN_MODEL, None)


@register("embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default hashing encoder over every document (batched mapInPandas)."""
    docs = fixtures.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text")
    return embed.embed(docs).select("doc_id", "vector")


# --- validation ---------------------------------------------------------------

@register("dataset_violations")
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V10 + J4: one row per rule with count and smallest offending id."""
    from lumenrank.operators import validate
    return validate.violations(fixtures.dirty_set(spark, sf_dir))


@register("clean_dataset")
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that survive coercion and both-end resolution."""
    from lumenrank.operators import validate
    return validate.clean(fixtures.dirty_set(spark, sf_dir)).qrels.select("query_id", "corpus_id", "score")


@register("rejected_rows")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3-V9: the rows that cleaning leaves out, each with its rule."""
    from lumenrank.operators import validate
    return validate.rejected_rows(fixtures.dirty_set(spark, sf_dir))


@register("query_bank")
def query_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries restricted to those with at least one clean judgment."""
    from lumenrank.operators import validate
    q = validate.clean(fixtures.dirty_set(spark, sf_dir)).queries
    return q.select("id", "text")


# --- sampling -----------------------------------------------------------------

SAMPLE_SEED = 42
SAMPLE_CORPUS = 100
SAMPLE_QUERIES = 10


def _fixed_sample(spark, sf_dir):
    from lumenrank.operators import sampling
    rs = fixtures.known_set(spark, sf_dir)
    return sampling.sample(rs, SAMPLE_CORPUS, SAMPLE_SEED, SAMPLE_QUERIES)


@register("sample_fixed_queries")
def sample_fixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained corpus and query ids of a seeded sample."""
    s = _fixed_sample(spark, sf_dir)
    return (s.data.corpus.select(F.lit("corpus").alias("kind"), "id")
            .unionByName(s.data.queries.select(F.lit("query").alias("kind"), "id")))


@register("sample_stats")
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + M14: statistics row of the seeded sample."""
    return _fixed_sample(spark, sf_dir).stats


@register("sample_greedy")
def sample_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: budgeted greedy query choice, exact, in distributed rounds."""
    from lumenrank.operators import sampling
    rs, budget = fixtures.greedy_set(spark, sf_dir)
    return sampling.greedy_queries(rs.queries, metrics.positives(rs.qrels), budget, SAMPLE_SEED)


# --- comparison -----------------------------------------------------------------

QUALITY = "mrr@10"


@register("pareto_flags")
def pareto_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: Pareto optimality per project (quality up, latency down)."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    return compare.pareto_flags(results, QUALITY).select("project", "model", "is_pareto")


@register("pareto_frontier")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: frontier points per project in latency order (projects with > 1 point)."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    return compare.pareto_frontier(compare.pareto_flags(results, QUALITY), QUALITY)


@register("cost_per_model")
def cost_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: embedding cost per model, BM25 excluded."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    return compare.cost_per_model(results).orderBy(F.col("total_embed_time_ms").desc())


@register("cost_percent")
def cost_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: cost as a percentage of the most expensive model."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    return compare.cost_percent(compare.cost_per_model(results))


@register("report_rows")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, null-normalised report rows with display labels."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    r = compare.report_query(compare.report_columns(results, QUALITY), text="standard",
                             sort_col=QUALITY, descending=True)
    return r.select("model", compare.display_label(F.col("model_short"), F.col("alpha")).alias("label"),
                    F.col(f"`{QUALITY}`"), "avg_embed_time_ms")


@register("report_bars")
def report_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar widths, memory clamp, bubble sizes."""
    from lumenrank.operators import compare
    results, memory = fixtures.runs_set(spark, sf_dir)
    return compare.report_bars(results, memory, QUALITY)


@register("axis_limits")
def axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality axis limits per project."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    a = compare.axis_limits(results, QUALITY)
    return a.select("project", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("results_wide")
def results_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric rows pivoted to one column per metric@k."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    mrr = results.where(F.col(f"`{QUALITY}`").isNotNull()).select(
        "p_partkey", "model", "alpha", F.lit("mrr").alias("metric"), F.lit(10).alias("k"),
        F.col(f"`{QUALITY}`").alias("value"))
    hit = results.where(F.col("p_partkey") % 3 == 0).select(
        "p_partkey", "model", "alpha", F.lit("hit_rate").alias("metric"), F.lit(3).alias("k"),
        (F.col("avg_embed_time_ms") / 50.0).alias("value"))
    return compare.results_wide(mrr.unionByName(hit), ["p_partkey", "model", "alpha"])


# --- text, prompts, generation -------------------------------------------------

def _docs(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text")


@register("truncate_tokens")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 + X4: document view with text cut after 512 tokens."""
    from lumenrank.functions.text import truncate_tokens as tt
    return _docs(spark, sf_dir).select(F.col("id").alias("doc_id"), tt(F.col("text"), 512).alias("text"))


@register("prefix_text")
def prefix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding-side passage prefix (lexical text stays raw)."""
    from lumenrank.functions.text import with_prefix
    return _docs(spark, sf_dir).select(F.col("id").alias("doc_id"),
                                       with_prefix(F.col("text"), "passage: ").alias("embed_text"),
                                       F.col("text").alias("lexical_text"))


@register("prompts")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation prompt per whole document (5 queries)."""
    from lumenrank.operators import generate
    return _docs(spark, sf_dir).select(F.col("id").alias("doc_id"),
                                       generate.prompt(F.col("text")).alias("prompt"))


@register("parse_generated_lines")
def parse_generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of ``conversations`` parsed as model output."""
    from lumenrank.operators import generate
    c = fixtures.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.posexplode(generate.parse_lines(F.col("text"))).alias("pos", "query")
                    ).select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("position"), "query")


@register("generated_queries_qrels")
def generated_queries_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 + X1: queries and judgments generated from every document."""
    from lumenrank.operators import generate
    q, r = generate.generated_sets(_docs(spark, sf_dir), generate.echo_generator)
    return q.join(r.withColumnRenamed("query_id", "id"), "id").select(
        F.col("id").alias("query_id"), "text", "corpus_id", F.col("score").cast("long").alias("score"))


@register("generation_stats")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 + T4: queries per document and the first five generated queries."""
    from lumenrank.operators import generate
    docs = _docs(spark, sf_dir)
    q, _ = generate.generated_sets(docs, generate.echo_generator)
    q = q.persist(StorageLevel.MEMORY_AND_DISK)
    n_q, n_d = q.count(), docs.count()
    first5 = (q.withColumn("i", F.split_part("id", F.lit("_"), F.lit(2)).cast("long"))
              .orderBy("i").limit(5))
    return first5.select(F.col("id").alias("query_id"),
                         F.concat(F.substring("text", 1, 60),
                                  F.when(F.length("text") > 60, F.lit("...")).otherwise(F.lit("")))
                         .alias("preview"),
                         F.lit(n_q).cast("long").alias("num_queries"),
                         F.lit(n_d).cast("long").alias("num_documents"),
                         F.round(F.lit(n_q / n_d), 6).alias("queries_per_document"))


# --- cache keys and incremental work ----------------------------------------

CACHE_CUTOFFS = {"mrr": [1, 3, 10], "hit_rate": [3]}


def _keyed(spark, sf_dir):
    from lumenrank.functions import keys
    results, _ = fixtures.runs_set(spark, sf_dir)
    r = results.where(F.col("model") != "BM25")
    return r.select("p_partkey", "model", "alpha",
                    keys.embedding_key(F.col("project"), F.col("model"), "documents").alias("embedding_key"),
                    keys.eval_key(F.col("project"), F.col("model"), F.col("alpha"), 10,
                                  F.col("model_short"), CACHE_CUTOFFS).alias("eval_key"))


@register("cache_keys")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 + X9: embedding and evaluation cache keys for every run."""
    return _keyed(spark, sf_dir).drop("p_partkey")


@register("pending_work")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid minus runs whose evaluation key is already stored
    (stored = runs of even part keys)."""
    k = _keyed(spark, sf_dir)
    stored = k.where(F.col("p_partkey") % 2 == 0).select("eval_key")
    return k.join(stored, "eval_key", "left_anti").select("model", "alpha", "eval_key")


# --- catalog --------------------------------------------------------------------

@register("catalog_tasks")
def catalog_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval-type tasks, one row per task record."""
    from lumenrank.operators import catalog
    t = catalog.record_fields(fixtures.catalog_tasks(spark, sf_dir))
    return catalog.task_rows(catalog.filter_types(t))


@register("catalog_dedupe")
def catalog_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique (path, revision) with their sorted task names."""
    from lumenrank.operators import catalog
    t = catalog.record_fields(fixtures.catalog_tasks(spark, sf_dir))
    return catalog.dedupe(catalog.filter_types(t))


@register("catalog_complete_groups")
def catalog_complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with corpus, queries and qrels configs."""
    from lumenrank.operators import catalog
    return catalog.complete_groups(fixtures.catalog_configs(spark, sf_dir))


@register("catalog_best_version")
def catalog_best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best available version per suite and language."""
    from lumenrank.operators import catalog
    t = fixtures.catalog_tasks(spark, sf_dir)
    names = t.select(F.concat(F.lit("MTEB("), F.col("lang"), F.lit(", "), F.col("version"),
                              F.lit(")")).alias("name")).distinct()
    return catalog.best_versions(names)


@register("config_resolution")
def config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configurations that each request resolves to, or why it does not."""
    from lumenrank.operators import configs
    return configs.resolve(*fixtures.config_requests(spark, sf_dir))


@register("split_matching")
def split_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that belong together per request, or why there are none."""
    from lumenrank.operators import configs
    return configs.match_splits(*fixtures.split_requests(spark, sf_dir))


# --- names, metric choice, report cells, whole samples, contents ------------------

@register("catalog_resolved_names")
def catalog_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the benchmark that each requested name, alias or language means."""
    from lumenrank.operators import catalog
    return catalog.resolve_names(*fixtures.name_requests(spark, sf_dir))


@register("quality_metric_choice")
def quality_metric_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the metric that compares the runs of each project and latency, or why there is none."""
    from lumenrank.operators import compare
    results, _ = fixtures.runs_set(spark, sf_dir)
    return compare.quality_metric_rows(fixtures.metric_rows(results), ["project", "latency"])


@register("report_cells")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, normalised value and bar of every metric, latency and memory cell."""
    from lumenrank.operators import compare
    results, memory = fixtures.runs_set(spark, sf_dir)
    results = results.withColumn("hit_rate@3", F.when(F.col("p_partkey") % 3 == 0, F.col("avg_embed_time_ms") / 50.0)
                                 .when(F.col("p_partkey") % 3 == 1, F.lit(float("nan"))))
    return compare.report_cells(results, memory, ["p_partkey", "model"])


@register("memory_rows")
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory per model, not below 0, the largest peak first."""
    from lumenrank.operators import compare
    _, memory = fixtures.runs_set(spark, sf_dir)
    return compare.memory_rows(memory.withColumn("model_memory_mb", F.col("peak_memory_mb") / 2.0))


@register("sample_all_queries")
def sample_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus size that the corpus does not exceed keeps every query and document."""
    from lumenrank.operators import sampling
    rs = fixtures.known_set(spark, sf_dir)
    s = sampling.sample(rs, rs.corpus.count(), SAMPLE_SEED)
    return (s.data.corpus.select(F.lit("corpus").alias("kind"), "id")
            .unionByName(s.data.queries.select(F.lit("query").alias("kind"), "id")))


@register("content_keys")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding and evaluation keys of every source's documents that change with their texts."""
    from lumenrank.functions import keys
    docs = fixtures.table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("id"), "text")
    c = keys.content_fingerprints(docs, ["source"], ["id", "text"])
    model, of = F.lit("org/" + HASH_MODEL), F.col("content")
    return c.select("source", "content",
                    keys.embedding_key(F.col("source"), model, "documents", {"max_tokens": 512}, of).alias("embedding_key"),
                    keys.eval_key(F.col("source"), model, F.lit(0.5), 10, None, CACHE_CUTOFFS, None, of).alias("eval_key"))


@register("truncate_model_tokens")
def truncate_model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document view cut after 512 tokens of a tokenizer file."""
    import public_tokenizers

    from lumenrank.functions.text import tokenizer_file, truncate_by_tokenizer
    cut = truncate_by_tokenizer("text", 512, tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    # encoding costs far more than sending a text, and a large row group is read by one task
    return _docs(spark, sf_dir).repartition("id", "text").select(F.col("id").alias("doc_id"), cut.alias("text"))
