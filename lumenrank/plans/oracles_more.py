"""DuckDB oracles for dense, hybrid, late-interaction and encoder keys.

These score every query-document pair with a plain cross join: an oracle may be
brute force, the Spark plans may not.
"""

from __future__ import annotations

from lumenrank.plans.oracles import _SQL, KNOWN, bm25, ranked

TOKENS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def hashing_vectors(p: str, src: str, dim: int = 64) -> str:
    """Default single-vector encoder: signed md5 feature hashing, L2 norm, FLOAT."""
    tok = TOKENS.format(t="text")
    return f"""
{p}_tok AS (SELECT id, unnest({tok}) AS term FROM {src}),
{p}_b AS (
  SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS b,
         CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
  FROM {p}_tok
),
{p}_sum AS (SELECT id, b, sum(s) AS v FROM {p}_b GROUP BY id, b),
{p}_nrm AS (SELECT id, sqrt(sum(v * v)) AS nrm FROM {p}_sum GROUP BY id),
{p}_full AS (
  SELECT i.id, r.b,
         CASE WHEN n.nrm > 0 AND s.v IS NOT NULL THEN (s.v / n.nrm)::FLOAT ELSE 0.0::FLOAT END AS x
  FROM (SELECT id FROM {src}) i CROSS JOIN range({dim}) r(b)
  LEFT JOIN {p}_sum s ON s.id = i.id AND s.b = r.b
  LEFT JOIN {p}_nrm n ON n.id = i.id
),
{p}_vec AS (SELECT id, list(x ORDER BY b) AS v FROM {p}_full GROUP BY id)"""


def grid_metrics(rank_cte: str, qrels: str, queries_count: str, docs_count: str,
                 model_expr: str) -> str:
    return f"""
g_frr AS (
  SELECT r.alpha, r.query_id, min(r.rank) AS frr
  FROM {rank_cte} r JOIN {qrels} p ON r.query_id = p.query_id AND r.doc_id = p.corpus_id
  WHERE p.score > 0 GROUP BY r.alpha, r.query_id
),
g_alpha AS (SELECT DISTINCT alpha FROM {rank_cte})
SELECT {model_expr} AS model, a.alpha,
  round(coalesce(sum(CASE WHEN frr <= 1 THEN 1.0::DOUBLE / frr ELSE 0.0 END), 0) / {queries_count}, 6) AS "mrr@1",
  round(coalesce(sum(CASE WHEN frr <= 3 THEN 1.0::DOUBLE / frr ELSE 0.0 END), 0) / {queries_count}, 6) AS "mrr@3",
  round(coalesce(sum(CASE WHEN frr <= 10 THEN 1.0::DOUBLE / frr ELSE 0.0 END), 0) / {queries_count}, 6) AS "mrr@10",
  round(coalesce(sum(CASE WHEN frr <= 3 THEN 1.0::DOUBLE ELSE 0.0 END), 0) / {queries_count}, 6) AS "hit_rate@3",
  {queries_count} AS num_queries, {docs_count} AS num_documents
FROM g_alpha a LEFT JOIN g_frr f ON f.alpha = a.alpha
GROUP BY a.alpha"""


def fusion(lex_scores: str, sem: str, n_docs: str, alphas: list[float], with_ends: bool) -> str:
    """Reference fusion over brute-force semantic scores ``{sem}(query_id, doc_id, sem)``."""
    arr = ", ".join(repr(a) for a in alphas)
    parts = f"""
f_lexc AS (
  SELECT * FROM {lex_scores}
),
f_lexn AS (
  SELECT query_id, doc_id,
         CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE (score - mn) / (mx - mn) END AS nl
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS mn,
                  max(score) OVER (PARTITION BY query_id) AS mx FROM f_lexc)
),
f_semn AS (
  SELECT query_id, doc_id, sem,
         CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE (sem - mn) / (mx - mn) END AS ns
  FROM (SELECT *, min(sem) OVER (PARTITION BY query_id) AS mn,
                  max(sem) OVER (PARTITION BY query_id) AS mx FROM {sem})
),
f_alpha AS (SELECT unnest([{arr}]::DOUBLE[]) AS alpha),
f_fused AS (
  SELECT a.alpha, s.query_id, s.doc_id,
         round(a.alpha * s.ns + (1.0::DOUBLE - a.alpha) * coalesce(l.nl, 0.0::DOUBLE), 9) AS score
  FROM f_semn s CROSS JOIN f_alpha a
  LEFT JOIN f_lexn l ON l.query_id = s.query_id AND l.doc_id = s.doc_id
),
f_all AS (
  SELECT alpha, query_id, doc_id, score FROM f_fused"""
    if with_ends:
        parts += f"""
  UNION ALL SELECT 1.0::DOUBLE, query_id, doc_id, round(sem, 9) FROM {sem}
  UNION ALL SELECT 0.0::DOUBLE, query_id, doc_id, score FROM {lex_scores}"""
    parts += """
),
f_rank AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank
    FROM f_all) WHERE rank <= 10
)"""
    return parts


# --- VEC -------------------------------------------------------------------

VEC = r"""
v_e AS (SELECT vec_id, embedding FROM embeddings),
v_q AS (
  SELECT vec_id,
         CASE WHEN b IS NULL THEN a::DOUBLE[]
              ELSE list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE + b[i]::DOUBLE) / 2.0) END AS v
  FROM (SELECT e.vec_id, e.embedding AS a, n.embedding AS b
        FROM v_e e LEFT JOIN v_e n ON n.vec_id = e.vec_id + 1)
),
v_sem AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(d.vec_id AS VARCHAR) AS doc_id,
         list_dot_product(q.v, d.embedding::DOUBLE[]) AS sem
  FROM v_q q CROSS JOIN v_e d
),
v_scores AS (SELECT query_id, doc_id, round(sem, 9) AS score FROM v_sem)"""

_SQL["dense_topk"] = "WITH " + VEC + "," + ranked("v_ranked", "v_scores", 10) + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM v_ranked"""

_SQL["dense_metrics"] = "WITH " + VEC + "," + ranked("v_ranked0", "v_scores", 10) + """,
v_ranked AS (SELECT 1.0::DOUBLE AS alpha, * FROM v_ranked0),
v_qrels AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS corpus_id,
                   1.0::DOUBLE AS score FROM v_e),""" + grid_metrics(
    "v_ranked", "v_qrels", "(SELECT count(*) FROM v_e)", "(SELECT count(*) FROM v_e)", "'embeddings'")

# --- HYB -------------------------------------------------------------------

HYB = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + "," + \
    hashing_vectors("hd", "k_corpus") + "," + hashing_vectors("hq", "k_queries") + """,
h_sem AS (
  SELECT q.id AS query_id, d.id AS doc_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS sem
  FROM hq_vec q CROSS JOIN hd_vec d
),"""

_SQL["hybrid_topk"] = HYB + fusion("b_scores", "h_sem", "(SELECT count(*) FROM k_corpus)", [0.5], False) + """
SELECT alpha, query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM f_rank"""

_SQL["hybrid_alpha_metrics"] = HYB + fusion(
    "b_scores", "h_sem", "(SELECT count(*) FROM k_corpus)", [0.25, 0.5, 0.75], True) + "," + grid_metrics(
    "f_rank", "k_qrels", "(SELECT count(*) FROM k_queries)", "(SELECT count(*) FROM k_corpus)",
    "CASE WHEN a.alpha = 0.0 THEN 'BM25' ELSE 'hashing-64' END")

_SQL["minmax_scores"] = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + """,
m_c AS (
  SELECT * FROM b_scores
)
SELECT query_id, doc_id, score,
       round(CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE (score - mn) / (mx - mn) END, 9) AS norm
FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS mn,
                max(score) OVER (PARTITION BY query_id) AS mx FROM m_c)"""

_SQL["embed_documents"] = "WITH d_src AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)," + \
    hashing_vectors("hd", "d_src") + """
SELECT id AS doc_id, v AS vector FROM hd_vec"""

# --- TOK -------------------------------------------------------------------

TOK = r"""
t_e AS (SELECT vec_id, embedding FROM embeddings),
t_q AS (
  SELECT vec_id, vec_id // 4 AS d,
         CASE WHEN b IS NULL THEN a::DOUBLE[]
              ELSE list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE + b[i]::DOUBLE) / 2.0) END AS v
  FROM (SELECT e.vec_id, e.embedding AS a, n.embedding AS b
        FROM t_e e LEFT JOIN t_e n ON n.vec_id = e.vec_id + 1)
),
t_pair AS (
  SELECT q.d AS qd, q.vec_id AS qtok, t.vec_id // 4 AS dd,
         max(list_dot_product(q.v, t.embedding::DOUBLE[])) AS mx
  FROM t_q q CROSS JOIN t_e t GROUP BY q.d, q.vec_id, t.vec_id // 4
),
t_sem AS (
  SELECT CAST(qd AS VARCHAR) AS query_id, CAST(dd AS VARCHAR) AS doc_id, sum(mx) AS sem
  FROM t_pair GROUP BY qd, dd
),
t_scores AS (SELECT query_id, doc_id, round(sem, 9) AS score FROM t_sem)"""

_SQL["maxsim_topk"] = "WITH " + TOK + "," + ranked("t_ranked", "t_scores", 10) + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM t_ranked"""

# A token's vector is +-1/4 in 16 places by the last 16 bits of its md5, so two tokens'
# product is 1 - (differing bits) / 8.
_LATE_TOKENS = TOKENS.format(t="text")
LATE = f"""
l_d AS (SELECT DISTINCT id, ('0x' || substr(md5(term), 29, 4))::INT AS code
        FROM (SELECT id, unnest({_LATE_TOKENS}) AS term FROM k_corpus)),
l_q AS (SELECT id, ('0x' || substr(md5(term), 29, 4))::INT AS code, count(*) AS n
        FROM (SELECT id, unnest({_LATE_TOKENS}) AS term FROM k_queries) GROUP BY 1, 2),
l_best AS (
  SELECT q.code, d.id AS doc_id, 1.0::DOUBLE - min(bit_count(xor(q.code, d.code))) / 8.0::DOUBLE AS mx
  FROM (SELECT DISTINCT code FROM l_q) q CROSS JOIN l_d d GROUP BY q.code, d.id),
l_sum AS (SELECT q.id AS query_id, b.doc_id, sum(q.n * b.mx) AS sem FROM l_q q JOIN l_best b USING (code) GROUP BY 1, 2),
l_sem AS (SELECT q.id AS query_id, d.id AS doc_id, coalesce(s.sem, 0.0::DOUBLE) AS sem
          FROM k_queries q CROSS JOIN k_corpus d LEFT JOIN l_sum s ON s.query_id = q.id AND s.doc_id = d.id)"""

_SQL["late_hybrid_metrics"] = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + "," + LATE + "," + fusion(
    "b_scores", "l_sem", "(SELECT count(*) FROM k_corpus)", [0.25, 0.5, 0.75], True) + "," + grid_metrics(
    "f_rank", "k_qrels", "(SELECT count(*) FROM k_queries)", "(SELECT count(*) FROM k_corpus)",
    "'token-hashing-16'")

# --- DIRTY -------------------------------------------------------------------

DIRTY = r"""
d_base AS (SELECT doc_id AS id, CASE WHEN doc_id % 97 = 5 THEN NULL ELSE text END AS text FROM documents),
d_corpus AS (SELECT * FROM d_base UNION ALL SELECT * FROM d_base WHERE id % 101 = 7),
d_queries AS (
  SELECT l.doc_id AS id, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  WHERE l.doc_id % 73 <> 4
),
d_qrels AS (
  SELECT CAST(doc_id AS VARCHAR) AS query_id,
         CAST(CASE WHEN doc_id % 89 = 3 THEN doc_id + 10000000 ELSE doc_id END AS VARCHAR) AS corpus_id,
         TRY_CAST(CASE WHEN doc_id % 83 = 1 THEN 'high' WHEN doc_id % 79 = 2 THEN 'NaN'
                       ELSE CAST(quality AS VARCHAR) END AS DOUBLE) AS score
  FROM labels
)"""


def _id_rules(table: str, src: str) -> str:
    return f"""
SELECT '{table}' AS table_name, 'not_empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS n,
       NULL::VARCHAR AS sample_id FROM {src}
UNION ALL SELECT '{table}', 'text_present', count(*) FILTER (WHERE text IS NULL),
       min(CAST(id AS VARCHAR)) FILTER (WHERE text IS NULL) FROM {src}
UNION ALL SELECT '{table}', 'id_not_null', count(*) FILTER (WHERE id IS NULL), NULL FROM {src}
UNION ALL SELECT '{table}', 'id_unique', count(*), min(sid)
  FROM (SELECT CAST(id AS VARCHAR) AS sid FROM {src} WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""


_SQL["dataset_violations"] = "WITH " + DIRTY + ",\n" + r"""
fin AS (SELECT *, score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AS ok FROM d_qrels),
qids AS (SELECT DISTINCT CAST(id AS VARCHAR) AS query_id FROM d_queries),
cids AS (SELECT DISTINCT CAST(id AS VARCHAR) AS corpus_id FROM d_corpus)
""" + _id_rules("corpus", "d_corpus") + "\nUNION ALL" + _id_rules("queries", "d_queries") + r"""
UNION ALL SELECT 'qrels', 'not_empty', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, NULL FROM d_qrels
UNION ALL SELECT 'qrels', 'query_id_not_null', count(*) FILTER (WHERE query_id IS NULL), NULL FROM d_qrels
UNION ALL SELECT 'qrels', 'corpus_id_not_null', count(*) FILTER (WHERE corpus_id IS NULL), NULL FROM d_qrels
UNION ALL SELECT 'qrels', 'score_finite', count(*) FILTER (WHERE NOT ok), min(query_id) FILTER (WHERE NOT ok) FROM fin
UNION ALL SELECT 'qrels', 'query_id_exists', count(*), min(query_id)
  FROM d_qrels q WHERE query_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM qids i WHERE i.query_id = q.query_id)
UNION ALL SELECT 'qrels', 'corpus_id_exists', count(*), min(corpus_id)
  FROM d_qrels q WHERE corpus_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cids i WHERE i.corpus_id = q.corpus_id)
UNION ALL SELECT 'queries', 'has_positive', count(*), min(query_id)
  FROM qids i WHERE NOT EXISTS (SELECT 1 FROM fin f WHERE f.query_id = i.query_id AND f.ok AND f.score > 0)"""

CLEAN = "WITH " + DIRTY + r""",
c_corpus AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id, text FROM d_corpus WHERE id IS NOT NULL AND text IS NOT NULL),
c_qrels AS (
  SELECT query_id, corpus_id, score FROM d_qrels
  WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)
    AND corpus_id IN (SELECT id FROM c_corpus)
    AND query_id IN (SELECT CAST(id AS VARCHAR) FROM d_queries)
)"""

_SQL["clean_dataset"] = CLEAN + "\nSELECT query_id, corpus_id, score FROM c_qrels"

_SQL["rejected_rows"] = CLEAN + """
SELECT 'corpus' AS table_name, CASE WHEN id IS NULL THEN 'id_not_null' ELSE 'text_present' END AS rule,
       NULL::VARCHAR AS query_id, CAST(id AS VARCHAR) AS corpus_id, count(*) AS n
FROM d_corpus WHERE id IS NULL OR text IS NULL GROUP BY 2, id
UNION ALL SELECT 'corpus', 'id_unique', NULL, CAST(id AS VARCHAR), count(*) - 1
  FROM d_corpus WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'queries', CASE WHEN id IS NULL THEN 'id_not_null' ELSE 'text_present' END,
       CAST(id AS VARCHAR), NULL, count(*) FROM d_queries WHERE id IS NULL OR text IS NULL GROUP BY 2, id
UNION ALL SELECT 'queries', 'id_unique', CAST(id AS VARCHAR), NULL, count(*) - 1
  FROM d_queries WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'queries', 'has_judgment', CAST(id AS VARCHAR), NULL, 1
  FROM d_queries WHERE id IS NOT NULL AND text IS NOT NULL AND CAST(id AS VARCHAR) NOT IN (SELECT query_id FROM c_qrels)
UNION ALL SELECT 'qrels', rule, query_id, corpus_id, 1 FROM (
  SELECT *, CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN 'score_finite'
                 WHEN corpus_id NOT IN (SELECT id FROM c_corpus) THEN 'corpus_id_exists'
                 WHEN query_id NOT IN (SELECT CAST(id AS VARCHAR) FROM d_queries) THEN 'query_id_exists' END AS rule
  FROM d_qrels) WHERE rule IS NOT NULL"""

_SQL["query_bank"] = CLEAN + """
SELECT CAST(id AS VARCHAR) AS id, text FROM d_queries
WHERE CAST(id AS VARCHAR) IN (SELECT query_id FROM c_qrels)"""

# --- sampling -------------------------------------------------------------------

SAMPLE = "WITH " + KNOWN + r""",
s_sel AS (SELECT id AS query_id FROM k_queries ORDER BY md5(id || ':42'), id LIMIT 10),
s_pos AS (
  SELECT DISTINCT corpus_id AS doc_id FROM k_qrels
  WHERE score > 0 AND query_id IN (SELECT query_id FROM s_sel)
),
s_dis AS (
  SELECT id AS doc_id FROM k_corpus WHERE id NOT IN (SELECT doc_id FROM s_pos)
  QUALIFY row_number() OVER (ORDER BY md5(id || ':42'), id) <= greatest(0, 100 - (SELECT count(*) FROM s_pos))
),
s_keep AS (SELECT doc_id FROM s_pos UNION SELECT doc_id FROM s_dis),
s_qrels AS (
  SELECT * FROM k_qrels WHERE query_id IN (SELECT query_id FROM s_sel)
    AND corpus_id IN (SELECT doc_id FROM s_keep)
)"""

_SQL["sample_fixed_queries"] = SAMPLE + """
SELECT 'corpus' AS kind, id FROM k_corpus WHERE id IN (SELECT doc_id FROM s_keep)
UNION ALL
SELECT 'query', id FROM k_queries WHERE id IN (SELECT query_id FROM s_sel)"""

_SQL["sample_stats"] = SAMPLE + """
SELECT 42::BIGINT AS seed, 100::BIGINT AS requested_corpus_size, 10::BIGINT AS requested_query_size,
  (SELECT count(*) FROM k_corpus) AS original_corpus_size,
  (SELECT count(*) FROM k_queries) AS original_query_size,
  (SELECT count(*) FROM k_qrels) AS original_qrels_size,
  (SELECT count(*) FROM s_keep) AS sampled_corpus_size,
  (SELECT count(*) FROM s_sel) AS sampled_query_size,
  (SELECT count(*) FROM s_qrels) AS sampled_qrels_size,
  (SELECT count(*) FROM s_pos) AS selected_positive_documents,
  round((SELECT count(*) FROM s_pos)::DOUBLE
        / (SELECT count(DISTINCT corpus_id) FROM k_qrels WHERE score > 0), 6) AS positive_document_coverage,
  1.0::DOUBLE AS selected_query_positive_document_coverage,
  round((SELECT count(*) FROM s_qrels)::DOUBLE / (SELECT count(*) FROM s_sel), 6) AS judgments_per_query"""

# Sequential greedy scan as a recursive CTE: one step per query in seeded order.
_SQL["sample_greedy"] = r"""
WITH RECURSIVE
g_q AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS query_id, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS pos
  FROM lineitem GROUP BY l_orderkey
),
g_o AS (SELECT query_id, pos, row_number() OVER (ORDER BY md5(query_id || ':42'), query_id) AS i FROM g_q),
g_b AS (SELECT greatest(1, count(*) // 10) AS b FROM part),
walk(i, sel, took) AS (
  SELECT i, pos, true FROM g_o WHERE i = 1
  UNION ALL
  SELECT o.i,
         CASE WHEN len(list_distinct(list_concat(w.sel, o.pos))) <= (SELECT b FROM g_b)
              THEN list_distinct(list_concat(w.sel, o.pos)) ELSE w.sel END,
         len(list_distinct(list_concat(w.sel, o.pos))) <= (SELECT b FROM g_b)
  FROM walk w JOIN g_o o ON o.i = w.i + 1
)
SELECT o.query_id FROM walk w JOIN g_o o ON o.i = w.i WHERE w.took"""

# --- RUNS -------------------------------------------------------------------------

RUNS = r"""
r_res AS (
  SELECT p_brand AS project,
         CASE WHEN p_partkey % 40 = 0 THEN 'BM25' ELSE 'm' || CAST(p_partkey AS VARCHAR) END AS model,
         CASE WHEN p_partkey % 40 = 0 THEN 'BM25' ELSE p_type END AS model_short,
         CASE WHEN p_partkey % 40 = 0 THEN 0.0::DOUBLE ELSE ((p_partkey % 4) + 1) / 4.0::DOUBLE END AS alpha,
         CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_retailprice / 2500.0::DOUBLE END AS "mrr@10",
         CASE WHEN p_partkey % 40 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS avg_embed_time_ms,
         CASE WHEN p_partkey % 40 = 0 THEN 0.0::DOUBLE ELSE p_size * 1000.0::DOUBLE END AS total_embed_time_ms,
         1000::BIGINT AS num_documents, p_partkey
  FROM part
),
r_types AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS pos FROM (SELECT DISTINCT p_type FROM part)),
r_mem AS (
  SELECT p_type AS model_short, CASE WHEN pos = 1 THEN pos * -100.0::DOUBLE ELSE pos * 100.0::DOUBLE END AS peak_memory_mb
  FROM r_types WHERE pos < (SELECT count(*) FROM r_types)
),
r_cmp AS (
  SELECT *, model <> 'BM25' AND "mrr@10" IS NOT NULL AND NOT isnan("mrr@10") AND NOT isinf("mrr@10")
            AND avg_embed_time_ms IS NOT NULL AND NOT isinf(avg_embed_time_ms) AS cmp FROM r_res
),
r_flag AS (
  SELECT a.*, CASE WHEN NOT a.cmp THEN NULL ELSE NOT EXISTS (
      SELECT 1 FROM r_cmp b
      WHERE b.cmp AND b.project = a.project AND b.model <> a.model
        AND b."mrr@10" >= a."mrr@10" AND b.avg_embed_time_ms <= a.avg_embed_time_ms
        AND (b."mrr@10" > a."mrr@10" OR b.avg_embed_time_ms < a.avg_embed_time_ms)) END AS is_pareto
  FROM r_cmp a
)"""

_SQL["pareto_flags"] = "WITH " + RUNS + "\nSELECT project, model, is_pareto FROM r_flag"

_SQL["pareto_frontier"] = "WITH " + RUNS + """
SELECT project, model, avg_embed_time_ms, "mrr@10",
       row_number() OVER (PARTITION BY project ORDER BY avg_embed_time_ms, model)::BIGINT AS position
FROM r_flag
WHERE is_pareto AND project IN (SELECT project FROM r_flag WHERE is_pareto GROUP BY project HAVING count(*) > 1)"""

_SQL["cost_per_model"] = "WITH " + RUNS + """
SELECT model, max(model_short) AS model_short, max(total_embed_time_ms) AS total_embed_time_ms,
       max(num_documents) AS num_documents
FROM r_res WHERE model <> 'BM25' GROUP BY model"""

_SQL["cost_percent"] = "WITH " + RUNS + """,
c AS (SELECT model, max(model_short) AS model_short, max(total_embed_time_ms) AS t
      FROM r_res WHERE model <> 'BM25' GROUP BY model)
SELECT model, model_short, t AS total_embed_time_ms, round(t / (SELECT max(t) FROM c) * 100.0, 6) AS cost_percent FROM c"""

_SQL["report_rows"] = "WITH " + RUNS + """
SELECT model, printf('%s (α=%.1f)', model_short, alpha) AS label,
       CASE WHEN isnan("mrr@10") THEN NULL ELSE "mrr@10" END AS "mrr@10",
       CASE WHEN model = 'BM25' THEN NULL ELSE avg_embed_time_ms END AS avg_embed_time_ms
FROM r_res
WHERE contains(lower(model_short), 'standard') OR contains(lower(model), 'standard')"""

_SQL["report_bars"] = "WITH " + RUNS + """,
j AS (SELECT r.*, CASE WHEN m.peak_memory_mb IS NOT NULL THEN greatest(0.0, m.peak_memory_mb) END AS memory_mb FROM r_res r LEFT JOIN r_mem m USING (model_short)),
g AS (
  SELECT min("mrr@10") AS qmn, max("mrr@10") AS qmx,
         min(avg_embed_time_ms) FILTER (WHERE avg_embed_time_ms > 0) AS lmn,
         max(avg_embed_time_ms) FILTER (WHERE avg_embed_time_ms > 0) AS lmx,
         min(memory_mb) FILTER (WHERE memory_mb > 0) AS mmn,
         max(memory_mb) FILTER (WHERE memory_mb > 0) AS mmx
  FROM j
)
SELECT model, model_short,
  round(CASE WHEN "mrr@10" IS NULL OR qmx = qmn THEN 0.0 ELSE ("mrr@10" - qmn) / (qmx - qmn) * 100.0 END, 6) AS quality_bar,
  round(CASE WHEN NOT (avg_embed_time_ms > 0) OR lmx = lmn THEN 0.0
             ELSE (avg_embed_time_ms - lmn) / (lmx - lmn) * 100.0 END, 6) AS latency_bar,
  memory_mb,
  round(CASE WHEN memory_mb IS NULL THEN 300.0 WHEN mmx = mmn OR mmn IS NULL THEN 500.0
             ELSE 100.0 + (memory_mb - mmn) / (mmx - mmn) * 1900.0 END, 6) AS bubble_size
FROM j, g"""

_SQL["axis_limits"] = "WITH " + RUNS + """
SELECT project, round(greatest(0.0, min("mrr@10") * 0.9), 6) AS lo, round(least(1.0, max("mrr@10") * 1.1), 6) AS hi
FROM r_res WHERE "mrr@10" IS NOT NULL GROUP BY project"""

_SQL["results_wide"] = "WITH " + RUNS + """
SELECT p_partkey, model, alpha,
       max(CASE WHEN "mrr@10" IS NOT NULL THEN "mrr@10" END) AS "mrr@10",
       max(CASE WHEN p_partkey % 3 = 0 THEN avg_embed_time_ms / 50.0 END) AS "hit_rate@3"
FROM r_res
WHERE "mrr@10" IS NOT NULL OR p_partkey % 3 = 0
GROUP BY p_partkey, model, alpha"""

# --- text, prompts, generation -------------------------------------------------

def trunc(t: str, n: int = 512) -> str:
    """Cut after token ``n``: join the leading alternating word / separator runs."""
    toks = TOKENS.format(t=t)
    runs = "regexp_extract_all(" + t + r", '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')"
    k = f"CASE WHEN regexp_matches({t}, '^[\\p{{L}}\\p{{N}}]') THEN {2 * n - 1} ELSE {2 * n} END"
    return (f"CASE WHEN len({toks}) <= {n} THEN {t} "
            f"ELSE array_to_string(({runs})[1:{k}], '') END")


_SQL["truncate_tokens"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + trunc("text") + " AS text FROM documents"

_SQL["prefix_text"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'passage: ' || text AS embed_text,
text AS lexical_text FROM documents"""

_PROMPT_HEAD = "Text to be found:\n"
_PROMPT_MID = "\n\nWrite "
_PROMPT_TAIL = (" searches, each on its own line, with which different people could look for this text. "
                "Mix short keywords with full questions, use the language of the text, and add nothing else.")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SQL["prompts"] = ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, " + _sql_str(_PROMPT_HEAD) + " || text || " + _sql_str(_PROMPT_MID) + " || '5' || " + _sql_str(_PROMPT_TAIL) +
                   " AS prompt FROM documents")

PY_SPACE = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


def parsed(t: str) -> str:
    strip = "regexp_replace({x}, '^" + PY_SPACE + "+|" + PY_SPACE + "+$', '', 'g')"
    return ("list_transform(list_filter(list_transform(string_split(" + strip.replace("{x}", t) +
            ", chr(10)), lambda x: " + strip.replace("{x}", "x") + "), lambda x: x <> ''), "
            "lambda x: regexp_replace(x, '^[0-9.\\- ]+', ''))")


_SQL["parse_generated_lines"] = """
SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS position, unnest(l) AS query
FROM (SELECT conv_id, turn, """ + parsed("text") + """ AS l FROM conversations WHERE role = 'assistant')"""

GEN = """
gen_l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, """ + parsed("text") + """ AS l FROM documents),
gen_x AS (SELECT doc_id, unnest(range(0, len(l))) AS position, unnest(l) AS text FROM gen_l),
gen_q AS (SELECT 'query_' || CAST(row_number() OVER (ORDER BY doc_id, position) - 1 AS VARCHAR) AS query_id,
                 row_number() OVER (ORDER BY doc_id, position) - 1 AS i, text, doc_id FROM gen_x)"""

_SQL["generated_queries_qrels"] = "WITH " + GEN + """
SELECT query_id, text, doc_id AS corpus_id, 1::BIGINT AS score FROM gen_q"""

_SQL["generation_stats"] = "WITH " + GEN + """
SELECT query_id, substr(text, 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS preview,
       (SELECT count(*) FROM gen_q) AS num_queries, (SELECT count(*) FROM documents) AS num_documents,
       round((SELECT count(*) FROM gen_q)::DOUBLE / (SELECT count(*) FROM documents), 6) AS queries_per_document
FROM gen_q ORDER BY i LIMIT 5"""

# --- cache keys -------------------------------------------------------------------

KEYED = "WITH " + RUNS + r""",
k AS (
  SELECT p_partkey, model, alpha,
    project || '_' || model || '_documents_' || substr(md5(project || '_' || model || '_documents'), 1, 8) AS embedding_key,
    project || '_' || model_short || '_a' || CAST(alpha AS VARCHAR) || '_k10_' ||
      substr(md5(project || '_' || model || '_' || model_short || '_alpha' || CAST(alpha AS VARCHAR) || '_k10'
                 || '_metrics[(''hit_rate'', [3]), (''mrr'', [1, 3, 10])]'), 1, 8) AS eval_key
  FROM r_res WHERE model <> 'BM25'
)"""

_SQL["cache_keys"] = KEYED + "\nSELECT model, alpha, embedding_key, eval_key FROM k"

_SQL["pending_work"] = KEYED + """
SELECT model, alpha, eval_key FROM k
WHERE eval_key NOT IN (SELECT eval_key FROM k WHERE p_partkey % 2 = 0)"""

# --- catalog -------------------------------------------------------------------------

CATALOG = r"""
ct AS (
  SELECT source AS dataset_path, lang, lang || '-' || CAST(doc_id % 7 AS VARCHAR) AS task_name,
         'r' || CAST(doc_id % 3 AS VARCHAR) AS dataset_revision,
         (['Retrieval', 'InstructionRetrieval', 'Any2AnyRetrieval', 'Any2AnyMultilingualRetrieval',
           'Reranking'])[doc_id % 5 + 1] AS task_type,
         (['v1', 'v2', 'v3', 'classic'])[doc_id % 4 + 1] AS version
  FROM documents
),
ctf AS (SELECT * FROM ct WHERE task_type IN ('Retrieval', 'InstructionRetrieval', 'Any2AnyRetrieval',
                                              'Any2AnyMultilingualRetrieval'))"""

_SQL["catalog_tasks"] = "WITH " + CATALOG + """
SELECT task_name, task_type, dataset_path, dataset_revision FROM ctf"""

_SQL["catalog_dedupe"] = "WITH " + CATALOG + """
SELECT dataset_path, dataset_revision, list_sort(list(DISTINCT task_name)) AS tasks,
       array_to_string(list_sort(list(DISTINCT task_name)), ';') AS tasks_csv,
       count(DISTINCT task_name) AS n_tasks
FROM ctf GROUP BY dataset_path, dataset_revision"""

_SQL["catalog_complete_groups"] = """
WITH g AS (
  SELECT source, lang, bool_or(doc_id % 2 = 0) AS has_even,
         bool_or(doc_id IN (SELECT doc_id FROM labels)) AS has_label
  FROM documents GROUP BY source, lang
)
SELECT source AS dataset, lang FROM g WHERE has_even AND has_label"""

_SQL["catalog_best_version"] = "WITH " + CATALOG + """,
names AS (SELECT DISTINCT lang, version FROM ct),
norm AS (
  SELECT 'MTEB(' || lang || ', ' || version || ')' AS name, 'MTEB' AS suite,
         CASE WHEN lower(trim(lang)) = 'ger' THEN 'deu'
              WHEN length(lower(trim(lang))) = 2 THEN coalesce(map_extract_value(MAP {
                'en': 'eng', 'de': 'deu', 'fr': 'fra', 'es': 'spa', 'it': 'ita', 'pt': 'por',
                'nl': 'nld', 'sv': 'swe', 'no': 'nor', 'da': 'dan', 'fi': 'fin', 'ru': 'rus',
                'pl': 'pol', 'cs': 'ces', 'tr': 'tur', 'ar': 'ara', 'he': 'heb', 'hi': 'hin',
                'ja': 'jpn', 'ko': 'kor', 'zh': 'cmn'}, lower(trim(lang))), lower(trim(lang)))
              ELSE lower(trim(lang)) END AS lang_n,
         CASE WHEN lower(trim(version)) LIKE 'v%'
                THEN coalesce(100 + TRY_CAST(substr(lower(trim(version)), 2) AS INTEGER), 10)
              WHEN lower(trim(version)) = 'classic' THEN 1 ELSE 0 END AS rank
  FROM names
)
SELECT suite, lang_n AS lang, best_name, best_rank FROM (
  SELECT suite, lang_n, name AS best_name, rank AS best_rank,
         row_number() OVER (PARTITION BY suite, lang_n ORDER BY rank DESC, name DESC) AS rn
  FROM norm) WHERE rn = 1"""

# --- configurations and splits ------------------------------------------------

_SQL["config_resolution"] = r"""
WITH k AS (SELECT DISTINCT doc_id, source || '/' || (doc_id % 40) AS dataset, lang FROM documents),
lab AS (SELECT DISTINCT doc_id FROM labels),
c AS (
  SELECT DISTINCT dataset, lang || '-corpus' AS config FROM k
  UNION SELECT dataset, lang || '-queries' FROM k WHERE doc_id % 5 <> 0
  UNION SELECT dataset, lang || '-qrels' FROM k WHERE doc_id % 7 <> 0
  UNION SELECT lang || '/' || (doc_id % 6), 'corpus' FROM k
  UNION SELECT lang || '/' || (doc_id % 6), 'queries' FROM k WHERE doc_id % 6 <> 1
  UNION SELECT lang || '/' || (doc_id % 6), 'qrels' FROM k WHERE doc_id % 6 = 2
  UNION SELECT lang || '/' || (doc_id % 6), 'default' FROM k WHERE doc_id % 6 IN (2, 3)),
r AS (SELECT DISTINCT dataset, NULL::VARCHAR AS language FROM c
      UNION SELECT dataset, lang FROM k UNION SELECT lang || '/' || (doc_id % 6), lang FROM k WHERE doc_id % 2 = 0
      UNION SELECT dataset, 'xx' FROM k WHERE doc_id % 3 = 0),
per AS (
  SELECT dataset, bool_or(config = 'corpus') AND bool_or(config = 'queries') AS standard,
         bool_or(config = 'qrels') AS q, bool_or(config = 'default') AS f FROM c GROUP BY dataset),
l AS (
  SELECT a.dataset, substr(a.config, 1, length(a.config) - 7) AS lang FROM c a
  WHERE a.config LIKE '%-corpus'
    AND EXISTS (SELECT 1 FROM c b WHERE b.dataset = a.dataset AND b.config = substr(a.config, 1, length(a.config) - 7) || '-queries')
    AND EXISTS (SELECT 1 FROM c b WHERE b.dataset = a.dataset AND b.config = substr(a.config, 1, length(a.config) - 7) || '-qrels')),
n AS (SELECT dataset, list_sort(list(lang)) AS langs FROM l GROUP BY dataset),
e AS (
  SELECT r.dataset, r.language, p.standard, p.q, coalesce(n.langs, []::VARCHAR[]) AS langs,
         CASE WHEN p.standard THEN CASE WHEN r.language IS NOT NULL THEN 'language_refused' WHEN NOT p.q AND NOT p.f THEN 'qrels_missing' END
              WHEN n.langs IS NULL THEN 'incomplete'
              WHEN r.language IS NULL THEN CASE WHEN len(n.langs) > 1 THEN 'language_needed' END
              WHEN NOT list_contains(n.langs, r.language) THEN 'language_unknown' END AS error
  FROM r JOIN per p USING (dataset) LEFT JOIN n USING (dataset)),
u AS (SELECT *, CASE WHEN error IS NULL AND NOT standard THEN coalesce(language, langs[1]) END AS resolved FROM e)
SELECT dataset, language, resolved,
       CASE WHEN error IS NULL THEN CASE WHEN standard THEN 'corpus' ELSE resolved || '-corpus' END END AS corpus_config,
       CASE WHEN error IS NULL THEN CASE WHEN standard THEN 'queries' ELSE resolved || '-queries' END END AS queries_config,
       CASE WHEN error IS NULL THEN CASE WHEN NOT standard THEN resolved || '-qrels' WHEN q THEN 'qrels' ELSE 'default' END END AS qrels_config,
       error, CASE WHEN error IN ('language_needed', 'language_unknown') THEN langs ELSE []::VARCHAR[] END AS choices
FROM u"""

_SQL["split_matching"] = r"""
WITH k AS (SELECT doc_id, source || '/' || (doc_id % 40) AS dataset, lang FROM documents),
s AS (
  SELECT DISTINCT dataset, 'corpus' AS role, CASE WHEN doc_id % 3 = 0 THEN 'corpus' ELSE lang END AS split FROM k WHERE doc_id % 11 <> 0
  UNION SELECT dataset, 'queries', CASE WHEN doc_id % 4 = 0 THEN 'queries' ELSE lang END FROM k WHERE doc_id % 13 <> 0
  UNION SELECT dataset, 'qrels', lang FROM k WHERE doc_id % 17 <> 0),
r AS (SELECT DISTINCT dataset, NULL::VARCHAR AS split FROM k UNION SELECT dataset, lang FROM k WHERE doc_id % 2 = 0
      UNION SELECT dataset, 'test' FROM k WHERE doc_id % 19 = 0),
n AS (
  SELECT dataset, coalesce(list_sort(list(split) FILTER (WHERE role = 'corpus')), []::VARCHAR[]) AS cs,
         coalesce(list_sort(list(split) FILTER (WHERE role = 'queries')), []::VARCHAR[]) AS qs,
         coalesce(list_sort(list(split) FILTER (WHERE role = 'qrels')), []::VARCHAR[]) AS js FROM s GROUP BY dataset),
h AS (
  SELECT r.dataset, r.split, coalesce(cs, []::VARCHAR[]) AS cs, coalesce(qs, []::VARCHAR[]) AS qs, coalesce(js, []::VARCHAR[]) AS js,
         CASE WHEN r.split IS NULL THEN CASE WHEN len(js) = 1 THEN js[1] END WHEN list_contains(js, r.split) THEN r.split END AS j
  FROM r LEFT JOIN n USING (dataset)),
m AS (
  SELECT *, CASE WHEN list_contains(qs, j) THEN j WHEN list_contains(qs, 'queries') THEN 'queries' END AS q,
         CASE WHEN list_contains(cs, 'corpus') THEN 'corpus' WHEN list_contains(cs, j) THEN j WHEN len(cs) = 1 THEN cs[1] END AS c FROM h),
e AS (
  SELECT *, CASE WHEN len(cs) = 0 THEN 'corpus_missing' WHEN len(qs) = 0 THEN 'queries_missing' WHEN len(js) = 0 THEN 'qrels_missing'
                 WHEN j IS NULL AND split IS NOT NULL THEN 'split_unknown' WHEN j IS NULL THEN 'split_needed'
                 WHEN q IS NULL THEN 'queries_unmatched' WHEN c IS NULL THEN 'corpus_ambiguous' END AS error FROM m)
SELECT dataset, split, CASE WHEN error IS NULL THEN j END AS qrels_split, CASE WHEN error IS NULL THEN q END AS query_split,
       CASE WHEN error IS NULL THEN c END AS corpus_split, error,
       CASE WHEN error IN ('split_unknown', 'split_needed') THEN js WHEN error = 'queries_unmatched' THEN qs
            WHEN error = 'corpus_ambiguous' THEN cs ELSE []::VARCHAR[] END AS choices
FROM e"""

# --- names, metric choice, report cells, whole samples, contents ------------------

_SQL["catalog_resolved_names"] = "WITH " + CATALOG + """,
lv AS (
  SELECT DISTINCT lang, version,
         CASE WHEN lower(trim(lang)) = 'ger' THEN 'deu'
              WHEN length(lower(trim(lang))) = 2 THEN coalesce(map_extract_value(MAP {
                'en': 'eng', 'de': 'deu', 'fr': 'fra', 'es': 'spa', 'it': 'ita', 'pt': 'por',
                'nl': 'nld', 'sv': 'swe', 'no': 'nor', 'da': 'dan', 'fi': 'fin', 'ru': 'rus',
                'pl': 'pol', 'cs': 'ces', 'tr': 'tur', 'ar': 'ara', 'he': 'heb', 'hi': 'hin',
                'ja': 'jpn', 'ko': 'kor', 'zh': 'cmn'}, lower(trim(lang))), lower(trim(lang)))
              ELSE lower(trim(lang)) END AS n
  FROM ct),
b AS (
  SELECT 'MTEB(' || n || ', ' || version || ')' AS name, lang || '-' || version AS alias, n,
         CASE WHEN version LIKE 'v%' THEN coalesce(100 + TRY_CAST(substr(version, 2) AS INTEGER), 10)
              WHEN version = 'classic' THEN 1 ELSE 0 END AS rank
  FROM lv WHERE (ascii(lang) + ascii(substr(version, 2, 1))) % 3 <> 0),
best AS (SELECT n, name FROM b QUALIFY row_number() OVER (PARTITION BY n ORDER BY rank DESC, name DESC) = 1),
req AS (
  SELECT lang AS user_value, 'MTEB(' || n || ', v2)' AS cand, n FROM lv
  UNION SELECT 'MTEB(' || lang || ')', 'MTEB(' || n || ', v2)', n FROM lv
  UNION SELECT 'MTEB(' || lang || ', ' || version || ')', 'MTEB(' || n || ', ' || version || ')', n FROM lv
  UNION SELECT lang || '-' || version, lang || '-' || version, NULL FROM lv)
SELECT user_value, coalesce((SELECT max(name) FROM b WHERE b.name = cand), (SELECT max(name) FROM b WHERE b.alias = cand),
                            (SELECT name FROM best WHERE best.n = req.n), cand) AS resolved
FROM req"""

_SQL["quality_metric_choice"] = "WITH " + RUNS + """,
m AS (
  SELECT project, avg_embed_time_ms AS latency, 'mrr' AS metric, length(model_short) % 4 * 5 AS k
  FROM r_res WHERE length(model_short) % 4 > 0 AND "mrr@10" IS NOT NULL
  UNION ALL SELECT project, avg_embed_time_ms, 'hit_rate', p_partkey % 7 + 1 FROM r_res WHERE p_partkey % 3 = 0
  UNION ALL SELECT project, avg_embed_time_ms, 'recall', 100 FROM r_res),
g AS (SELECT project, latency, max(k) FILTER (WHERE metric = 'mrr') AS mk, max(k) FILTER (WHERE metric = 'hit_rate') AS hk
      FROM m GROUP BY project, latency)
SELECT project, latency, CASE WHEN mk IS NOT NULL THEN 'mrr@' || mk WHEN hk IS NOT NULL THEN 'hit_rate@' || hk END AS quality_metric,
       CASE WHEN mk IS NULL AND hk IS NULL THEN 'no quality column of a ranking metric' END AS error
FROM g"""

_SQL["report_cells"] = "WITH " + RUNS + """,
j AS (
  SELECT r.p_partkey, r.model, r."mrr@10" AS mrr, CASE WHEN r.p_partkey % 3 = 0 THEN r.avg_embed_time_ms / 50.0 END AS hit,
         CASE WHEN r.model <> 'BM25' THEN r.avg_embed_time_ms END AS lat,
         CASE WHEN m.peak_memory_mb IS NOT NULL THEN greatest(0.0, m.peak_memory_mb) END AS mem
  FROM r_res r LEFT JOIN r_mem m USING (model_short)),
c AS (
  SELECT p_partkey, model, 'mrr@10' AS "column", 'MRR @10' AS label, mrr AS value, mrr IS NOT NULL AS counted FROM j
  UNION ALL SELECT p_partkey, model, 'hit_rate@3', 'HIT_RATE @3', hit, hit IS NOT NULL FROM j
  UNION ALL SELECT p_partkey, model, 'avg_embed_time_ms', 'AVG_EMBED_TIME_MS', lat, coalesce(lat > 0, false) FROM j
  UNION ALL SELECT p_partkey, model, 'memory_mb', 'MEMORY_MB', mem, coalesce(mem > 0, false) FROM j)
SELECT p_partkey, model, "column", label, value, round(CASE WHEN counted AND mx > mn THEN (value - mn) / (mx - mn) * 100.0 ELSE 0.0 END, 6) AS bar
FROM (SELECT *, min(value) FILTER (WHERE counted) OVER (PARTITION BY "column") AS mn,
             max(value) FILTER (WHERE counted) OVER (PARTITION BY "column") AS mx FROM c)"""

_SQL["memory_rows"] = "WITH " + RUNS + """
SELECT model_short, greatest(0.0, peak_memory_mb) AS peak_memory_mb, greatest(0.0, peak_memory_mb / 2.0) AS model_memory_mb
FROM r_mem ORDER BY 2 DESC, 1"""

_SQL["sample_all_queries"] = "WITH " + KNOWN + """
SELECT 'corpus' AS kind, id FROM k_corpus UNION ALL SELECT 'query', id FROM k_queries"""

_SQL["content_keys"] = r"""
WITH d AS (SELECT source, md5(coalesce(md5(CAST(doc_id AS VARCHAR)), '-') || coalesce(md5(text), '-')) AS h FROM documents),
c AS (
  SELECT source, md5(count(*)::VARCHAR || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR) AS content FROM d GROUP BY source)
SELECT source, content,
  source || '_hashing-64_documents_' || substr(md5(source || '_org/hashing-64_documents_{"max_tokens": 512}_content' || content), 1, 8)
    AS embedding_key,
  source || '_hashing-64_a0.5_k10_' || substr(md5(source || '_org/hashing-64__alpha0.5_k10_metrics[(''hit_rate'', [3]), (''mrr'', [1, 3, 10])]'
    || '_content' || content), 1, 8) AS eval_key
FROM c"""
