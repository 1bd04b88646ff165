"""DuckDB SQL oracles, one per query key (independent formulations).

Tables are the driver's pre-registered views.  Lambdas use ``lambda x: …``.
"""

from __future__ import annotations

# --- shared CTE fragments ---------------------------------------------------

# KNOWN fixture: passages that occur verbatim in documents.
KNOWN = r"""
known_hits AS (
  SELECT DISTINCT b.item_id, d.doc_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  WHERE b.text IS NOT NULL AND length(b.text) > 0
),
k_corpus AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents),
k_queries AS (
  SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark
  WHERE item_id IN (SELECT item_id FROM known_hits)
),
k_qrels AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS corpus_id,
         1.0::DOUBLE AS score
  FROM known_hits
)"""

# BM25 over a corpus CTE named {corpus} and queries CTE named {queries}.
BM25 = r"""
{p}_toks AS (
  SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
                         lambda x: x <> '') AS t
  FROM {corpus}
),
{p}_stats AS (SELECT count(*) AS n, avg(len(t))::DOUBLE AS avgdl FROM {p}_toks),
{p}_tf AS (
  SELECT id AS doc_id, dl, term, count(*) AS tf
  FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM {p}_toks)
  GROUP BY id, dl, term
),
{p}_terms AS (
  SELECT term, count(*) AS df,
         ln(1.0::DOUBLE + ((SELECT n FROM {p}_stats) - count(*) + 0.5::DOUBLE)
                          / (count(*) + 0.5::DOUBLE)) AS idf
  FROM {p}_tf GROUP BY term
),
{p}_qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT id AS query_id,
               unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
                                  lambda x: x <> '')) AS term
        FROM {queries})
  GROUP BY query_id, term
),
{p}_scores AS (
  SELECT q.query_id, f.doc_id,
         round(sum((q.qtf * t.idf) *
                   (f.tf * 2.2::DOUBLE /
                    (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.dl / (SELECT avgdl FROM {p}_stats))))),
               9) AS score
  FROM {p}_qt q JOIN {p}_terms t USING (term) JOIN {p}_tf f USING (term)
  GROUP BY q.query_id, f.doc_id
)"""


def bm25(prefix: str, corpus: str, queries: str) -> str:
    return BM25.format(p=prefix, corpus=corpus, queries=queries)


def ranked(name: str, scores: str, k: int, part: str = "query_id") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, doc_id ASC) AS rank
    FROM {scores}) WHERE rank <= {k}
)"""


def metric_select(frr: str = "frr", n: str = "n") -> str:
    """Means over all queries from the first relevant rank (null = miss)."""
    return f"""
  round(sum(CASE WHEN {frr} <= 1 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END) / {n}, 6) AS "mrr@1",
  round(sum(CASE WHEN {frr} <= 3 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END) / {n}, 6) AS "mrr@3",
  round(sum(CASE WHEN {frr} <= 10 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END) / {n}, 6) AS "mrr@10",
  round(sum(CASE WHEN {frr} <= 3 THEN 1.0::DOUBLE ELSE 0.0 END) / {n}, 6) AS "hit_rate@3" """


def per_query_select(frr: str = "frr") -> str:
    return f"""
  round(CASE WHEN {frr} <= 1 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END, 6) AS "mrr@1",
  round(CASE WHEN {frr} <= 3 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END, 6) AS "mrr@3",
  round(CASE WHEN {frr} <= 10 THEN 1.0::DOUBLE / {frr} ELSE 0.0 END, 6) AS "mrr@10",
  round(CASE WHEN {frr} <= 3 THEN 1.0::DOUBLE ELSE 0.0 END, 6) AS "hit_rate@3" """


_SQL: dict[str, str] = {}

_SQL["term_statistics"] = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + """
SELECT term, df, round(idf, 9) AS idf FROM b_terms"""

_SQL["bm25_topk"] = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + "," + \
    ranked("b_ranked", "b_scores", 10) + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM b_ranked"""

_BM25_FRR = "WITH " + KNOWN + "," + bm25("b", "k_corpus", "k_queries") + "," + \
    ranked("b_ranked", "b_scores", 10) + """,
b_frr AS (
  SELECT r.query_id, min(r.rank) AS frr
  FROM b_ranked r JOIN k_qrels p ON r.query_id = p.query_id AND r.doc_id = p.corpus_id
  WHERE p.score > 0
  GROUP BY r.query_id
),
b_pq AS (SELECT q.id AS query_id, f.frr FROM k_queries q LEFT JOIN b_frr f ON q.id = f.query_id)
"""

_SQL["bm25_metrics"] = _BM25_FRR + """
SELECT 'BM25' AS model, 0.0::DOUBLE AS alpha,""" + metric_select("frr", "(SELECT count(*) FROM k_queries)") + """,
  (SELECT count(*) FROM k_queries) AS num_queries,
  (SELECT count(*) FROM k_corpus) AS num_documents
FROM b_pq"""

_SQL["rr_hit_per_query"] = _BM25_FRR + """
SELECT query_id, CAST(frr AS BIGINT) AS first_rel_rank,""" + per_query_select("frr") + """
FROM b_pq"""

_SQL["relevance_lists"] = "WITH " + KNOWN + """
SELECT q.id AS query_id, q.text AS query,
       list_sort(list(DISTINCT r.corpus_id) FILTER (WHERE r.corpus_id IS NOT NULL)) AS relevant_ids
FROM k_queries q LEFT JOIN k_qrels r ON r.query_id = q.id AND r.score > 0
GROUP BY q.id, q.text"""


def all_sql() -> dict[str, str]:
    from lumenrank.plans import oracles_more  # noqa: F401
    return dict(_SQL)
