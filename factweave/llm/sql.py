"""DuckDB SQL of the queries that SQL expresses over whole tables."""

P1_FOUND = """
WITH best AS (
  SELECT query_id, source, fact_id, max(score + 0.0) AS score FROM scored_facts
  WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND fact_id IS NOT NULL
  GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, fact_id) AS r FROM best),
e AS (
  SELECT example_id, system, unnest(document_ranking) AS p, generate_subscripts(document_ranking, 1) AS pos FROM baseline_results),
g AS (
  SELECT example_id, p, min(pos) AS pos, count(DISTINCT system) AS systems FROM e
  WHERE p IS NOT NULL AND regexp_matches(p, '\\S') AND NOT starts_with(p, '__unmapped__:') AND example_id IS NOT NULL
  GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY pos, systems DESC, p) AS r FROM g)
SELECT 'fact' AS kind, query_id, source, fact_id AS item_id FROM f WHERE r <= 5
UNION ALL
SELECT 'document', example_id, 'document_ranking', p FROM d WHERE r <= 5
"""

_KEY = "nullif(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g'), '')"

P4_FOUND = f"""
WITH r AS (
  SELECT DISTINCT 'documents.domain' AS field_name, doc_id::VARCHAR AS id, {_KEY.format("domain")} AS category FROM documents
  UNION ALL
  SELECT DISTINCT 'benchmark_examples.query_type', example_id, {_KEY.format("query_type")} FROM benchmark_examples
  UNION ALL
  SELECT DISTINCT 'benchmark_examples.dataset', example_id, {_KEY.format("dataset")} FROM benchmark_examples),
pool AS (SELECT field_name, count(DISTINCT id) AS n FROM r GROUP BY 1),
have AS (SELECT field_name, category, count(DISTINCT id) AS n FROM r GROUP BY 1, 2)
SELECT t.field_name, t.category FROM sample_targets t
LEFT JOIN pool p ON p.field_name = t.field_name
LEFT JOIN have h ON h.field_name = t.field_name AND h.category = {_KEY.format("t.category")}
WHERE greatest(t.min_rows, ceil(round(t.target_share * coalesce(p.n, 0) / 5, 6))) > coalesce(h.n, 0)
"""
