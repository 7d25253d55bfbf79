"""DuckDB SQL equal to the queries of this subpackage, where SQL can express them."""

BEST = """
latest AS (
  SELECT query_id, scorer, record_id, chunk_index, score,
         row_number() OVER (PARTITION BY query_id, scorer, record_id, chunk_index ORDER BY scored_at DESC) AS n
  FROM search_hits),
best AS (
  SELECT l.query_id, l.scorer, l.record_id, max(CASE WHEN s.higher_is_better THEN score ELSE -score END) AS s
  FROM latest l JOIN scorers s ON s.scorer = l.scorer
  WHERE n = 1 AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY l.query_id, l.scorer, l.record_id),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id, scorer ORDER BY s DESC) AS r FROM best)"""

SQL = {
    "p4_found": """
WITH v AS (
  SELECT DISTINCT ON (chunk_id) chunk_id, len(vector) AS dim, list_transform(vector, lambda x: x::DOUBLE) AS v
  FROM chunks
  WHERE vector IS NOT NULL AND len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b
FROM v a JOIN v b ON a.dim = b.dim AND a.chunk_id < b.chunk_id
WHERE list_cosine_similarity(a.v, b.v) >= 0.95 - 1e-9""",
    "p5_found": f"""
WITH {BEST}
SELECT query_id, record_id FROM ranked WHERE r <= 20 GROUP BY query_id, record_id
HAVING count(*) = (SELECT count(DISTINCT scorer) FROM best b WHERE b.query_id = ranked.query_id)""",
    "p5_ranking": f"""
WITH {BEST},
lists AS (SELECT query_id, scorer, count(*) AS n FROM best GROUP BY ALL),
records AS (SELECT DISTINCT query_id, record_id FROM best),
grid AS (
  SELECT k.query_id, k.record_id, coalesce(r.r, l.n + 1) AS r, r.r IS NOT NULL AS listed
  FROM records k JOIN lists l USING (query_id) LEFT JOIN ranked r ON r.query_id = k.query_id AND r.record_id = k.record_id AND r.scorer = l.scorer),
m AS (
  SELECT query_id, record_id, list_sort(list(r))[((count(*) + 1) // 2)::INT]::DOUBLE AS median_rank, round(avg(r), 9) AS mean_rank,
         count_if(listed)::INT AS scorers_listing
  FROM grid GROUP BY query_id, record_id)
SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, record_id) AS position,
       median_rank, mean_rank, scorers_listing
FROM m""",
    "p1_whole": "SELECT DISTINCT chunk_id, true AS short, true AS shared, true AS whole FROM chunks WHERE length(text) > 0",
    "p9_checks": """SELECT source, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS known, true AS repeats_kept, true AS disjoint, true AS share_kept
FROM mix_targets WHERE source IS NOT NULL""",
}
