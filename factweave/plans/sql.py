"""DuckDB SQL of the core queries."""

_RESULTS = "SELECT DISTINCT ON (result_id) * FROM baseline_results WHERE result_id IS NOT NULL"
_EXAMPLES = "SELECT DISTINCT ON (example_id) * FROM benchmark_examples WHERE example_id IS NOT NULL"
_PASSAGES = "SELECT DISTINCT ON (passage_id) * FROM passages WHERE passage_id IS NOT NULL"
_EDGES = """
i AS (SELECT 'c' || o_custkey AS e, 'o' || o_orderkey AS f, 1.0::DOUBLE AS w FROM orders
  UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, 1 + l_discount FROM lineitem),
one AS (SELECT e, f, sum(w) AS w FROM i WHERE e IS NOT NULL AND f IS NOT NULL AND w IS NOT NULL GROUP BY ALL),
edges AS (SELECT e AS src, f AS dst, w FROM one UNION ALL SELECT f, e, w FROM one)
"""
_RANKED = f"""
r AS ({_RESULTS}),
e AS (SELECT example_id, list_distinct(list_filter([s.passage_id FOR s IN supporting_facts], lambda x: x IS NOT NULL)) AS gold FROM ({_EXAMPLES})),
u AS (SELECT result_id, p, min(pos) AS pos FROM (SELECT result_id, unnest(document_ranking) AS p, generate_subscripts(document_ranking, 1) AS pos FROM r)
  WHERE p IS NOT NULL AND regexp_matches(p, '\\S') GROUP BY ALL),
v AS (SELECT result_id, p, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS pos FROM u),
n AS (SELECT result_id, count(*) AS returned FROM v GROUP BY ALL),
b AS (SELECT r.result_id, r.system, e.example_id, e.gold, len(e.gold) AS g, coalesce(n.returned, 0) AS returned FROM r JOIN e USING (example_id) LEFT JOIN n USING (result_id)),
h AS (SELECT b.result_id, v.pos FROM b JOIN v USING (result_id) WHERE list_contains(b.gold, v.p))
"""
_KS = (1, 3, 5, 10, 20)
_METRICS = f"""
WITH {_RANKED}
SELECT b.result_id, b.system, b.example_id, CASE WHEN g > 0 THEN coalesce(1.0::DOUBLE / min(pos) FILTER (pos <= 20), 0) END AS mrr, CASE WHEN g > 0 THEN coalesce(1.0::DOUBLE / min(pos) FILTER (pos <= 20), 0) END AS mrr_20
{"".join(f'''
, CASE WHEN g > 0 THEN count(*) FILTER (pos <= {k}) / g::DOUBLE END AS recall_{k}
, CASE WHEN g > 0 THEN count(*) FILTER (pos <= {k}) / {k}::DOUBLE END AS precision_{k}
, CASE WHEN g > 0 THEN coalesce(count(*) FILTER (pos <= {k}) / nullif(least(b.returned, {k}), 0)::DOUBLE, 0) END AS returned_precision_{k}
, CASE WHEN g > 0 THEN (count(*) FILTER (pos <= {k}) = g)::INT::DOUBLE END AS complete_{k}
, CASE WHEN g > 0 THEN least(count(*) FILTER (pos <= {k}), 1)::DOUBLE END AS hit_{k}
, CASE WHEN g > 0 THEN round(coalesce(sum(1 / log2(pos + 1)) FILTER (pos <= {k}), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(g, {k}) + 1)]), 9) END AS ndcg_{k}''' for k in _KS)}
FROM b LEFT JOIN h USING (result_id) GROUP BY b.result_id, b.system, b.example_id, g, b.returned
"""
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '\[fact_[^\]]*\]', ' ', 'g')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
_F1 = f"""
WITH r AS ({_RESULTS}), e AS (SELECT example_id, unnest(answer) AS ref FROM ({_EXAMPLES})),
t AS (SELECT r.result_id, r.system, r.example_id, {_TOKENS.format("r.answer")} AS a, {_TOKENS.format("e.ref")} AS b FROM r JOIN e USING (example_id)),
s AS (SELECT result_id, system, example_id, CASE
    WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = len(b))::INT::DOUBLE
    WHEN ((len(a) = 1 AND a[1] IN ('yes', 'no', 'noanswer')) OR (len(b) = 1 AND b[1] IN ('yes', 'no', 'noanswer'))) AND a <> b THEN 0
    ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda y: y = w))))), 0)::DOUBLE / (len(a) + len(b)) END AS f
  FROM t)
SELECT result_id, system, example_id, round(max(f), 6) AS f1 FROM s GROUP BY ALL
"""
_DENSE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.x, v.x) / (greatest(sqrt(list_dot_product(q.x, q.x)), 1e-12) * greatest(sqrt(list_dot_product(v.x, v.x)), 1e-12)), 6) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
d AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
"""
_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

SQL = {
    "document_ids": "SELECT doc_id, 'doc_' || substr(sha256(coalesce(text, '')), 1, 16) AS content_id FROM documents",
    "split_partition": """
WITH d AS (SELECT example_id, ('0x' || substr(sha256(example_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM (SELECT DISTINCT example_id FROM benchmark_examples WHERE example_id IS NOT NULL))
SELECT example_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM d""",
    "section_split": r"""
WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE doc_id IS NOT NULL)),
h AS (SELECT *, regexp_matches(line, '^[ \t]*#') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section_no FROM h),
g AS (SELECT doc_id, section_no, max(regexp_replace(line, '^[ \t]*[# ]+|[# ]+$', '', 'g')) FILTER (head) AS t, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS text FROM s GROUP BY ALL)
SELECT doc_id, section_no, CASE WHEN section_no = 0 THEN 'Document' WHEN t = '' THEN 'Untitled' ELSE t END AS title, text FROM g WHERE regexp_matches(text, '\S')""",
    "chunk_counts": r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 64) / 48.0))::BIGINT + 1)) AS k FROM d WHERE n > 0)
SELECT doc_id, count(*) AS chunks, sum(least(64, n - 48 * k))::BIGINT AS tokens FROM c GROUP BY ALL""",
    "bm25_topk": rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.replace("text", "question")}) AS term FROM eval_items WHERE item_id % 20 = 0),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "dense_topk": f"{_DENSE} SELECT * FROM d WHERE rank <= 5",
    "seed_weights": f"{_DENSE}, k AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.05) AS e FROM d WHERE rank <= 5) SELECT query_id, vec_id, round(e / sum(e) OVER (PARTITION BY query_id), 5) AS weight FROM k",
    "rrf_fusion": """
WITH b AS (SELECT query_id, fact_id, source, min(rank) AS rank FROM scored_facts WHERE query_id IS NOT NULL AND fact_id IS NOT NULL AND rank IS NOT NULL GROUP BY ALL),
s AS (SELECT query_id, fact_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM b GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id))::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "graph_degree": f"WITH {_EDGES} SELECT src AS node, count(*) AS neighbours, round(sum(w), 4) AS degree FROM edges GROUP BY ALL",
    "spectral_bands": f"""
WITH {_EDGES}, a AS (SELECT * FROM edges UNION ALL SELECT DISTINCT src, src, 1.0 FROM edges), g AS (SELECT src, sum(w) AS d FROM a GROUP BY ALL),
p AS (SELECT a.src, a.dst, a.w / sqrt(x.d * y.d) AS w FROM a JOIN g x ON a.src = x.src JOIN g y ON a.dst = y.src),
x AS (SELECT 'o' || o_orderkey AS node, o_totalprice / 1000 AS v FROM orders),
z1 AS (SELECT p.src AS node, sum(p.w * x.v) AS v FROM p JOIN x ON p.dst = x.node GROUP BY ALL),
z2 AS (SELECT p.src AS node, sum(p.w * z1.v) AS v FROM p JOIN z1 ON p.dst = z1.node GROUP BY ALL),
n AS (SELECT DISTINCT src AS node FROM p),
c AS (SELECT n.node, coalesce(x.v, 0) AS raw, coalesce(z1.v, 0) AS z1, coalesce(z2.v, 0) AS low FROM n LEFT JOIN x USING (node) LEFT JOIN z1 USING (node) LEFT JOIN z2 USING (node))
SELECT node, round(raw, 6) AS raw, round(low, 6) AS low, round(z1 - low, 6) AS mid, round(raw - z1, 6) AS high FROM c""",
    "hop_reach": f"""
WITH {_EDGES}, h0 AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 20 = 0),
h1 AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (FROM h0)), h2 AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (FROM h1)),
h3 AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (FROM h2)), h4 AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (FROM h3)),
u AS (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3 UNION ALL SELECT node, 4 FROM h4)
SELECT node, min(hops) AS hops FROM u GROUP BY ALL""",
    "verify_evidence": f"""
WITH e AS (SELECT DISTINCT example_id, s.passage_id AS passage_id, s.sentence_index AS i FROM (SELECT example_id, unnest(supporting_facts) AS s FROM ({_EXAMPLES}))),
p AS (SELECT passage_id, len(sentences) AS n FROM ({_PASSAGES}))
SELECT CASE WHEN n IS NULL THEN 'missing_passage' WHEN i < 0 OR i >= n THEN 'index_out_of_range' ELSE 'accepted' END AS reason, count(*) AS links FROM e LEFT JOIN p USING (passage_id) GROUP BY ALL""",
    "ranking_metrics": _METRICS,
    "answer_f1": _F1,
    "summary_by_system": f"""
WITH m AS ({_METRICS}), u AS (SELECT system, metric, value FROM (SELECT system, mrr, recall_5, ndcg_5, precision_5 FROM m) UNPIVOT INCLUDE NULLS (value FOR metric IN (mrr, recall_5, ndcg_5, precision_5)))
SELECT system, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM u GROUP BY ALL""",
    "paired_cohen": f"""
WITH f AS ({_F1}), e AS (SELECT example_id, system, avg(f1) AS f1 FROM f GROUP BY ALL),
d AS (SELECT a.system AS system_a, b.system AS system_b, round(a.f1 - b.f1, 9) AS d FROM e a JOIN e b ON a.example_id = b.example_id AND a.system < b.system),
g AS (SELECT system_a, system_b, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY ALL)
SELECT system_a, system_b, n, round(m, 6) AS difference, round(CASE WHEN sd > 0 THEN m / sd WHEN m = 0 AND n > 1 THEN 0 END, 5) AS cohens_d FROM g""",
    "audit_counts": f"""
WITH e AS (SELECT DISTINCT example_id FROM benchmark_examples WHERE example_id IS NOT NULL), r AS ({_RESULTS}),
i AS (SELECT system, example_id, coalesce(max((status = 'success')::INT), 0) AS ok FROM r WHERE example_id IN (FROM e) GROUP BY ALL)
SELECT system, (SELECT count(*) FROM e) AS expected, count(*) AS received, (SELECT count(*) FROM e) - count(*) AS missing, sum(ok)::BIGINT AS succeeded, (count(*) - sum(ok))::BIGINT AS failed FROM i GROUP BY ALL""",
    "external_mapping": f"""
WITH u AS (SELECT DISTINCT result_id, p FROM (SELECT result_id, unnest(document_ranking) AS p FROM ({_RESULTS})) WHERE p IS NOT NULL AND regexp_matches(p, '\\S')),
k AS (SELECT DISTINCT passage_id FROM passages WHERE passage_id IS NOT NULL)
SELECT result_id, count(*) AS entries, count(passage_id) AS mapped, round(count(passage_id) / count(*)::DOUBLE, 6) AS coverage FROM u LEFT JOIN k ON u.p = k.passage_id GROUP BY ALL""",
    "canonical_entities": rf"""
WITH u AS (SELECT example_id, unnest(bridge_entities) AS name FROM ({_EXAMPLES})),
d AS (SELECT trim(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}\p{{M}}_\s+-]', ' ', 'g'), '\s+', ' ', 'g')) AS entity, name, min(example_id) AS seen, count(*) AS n FROM u WHERE regexp_matches(name, '\S') GROUP BY ALL)
SELECT 'bridge' AS entity_type, entity, arg_min(name, {{'seen': seen, 'name': name}}) AS canonical_name, string_agg(name, '|' ORDER BY name) AS aliases, sum(n)::BIGINT AS mentions FROM d GROUP BY ALL""",
    "context_budget": f"""
WITH d AS (SELECT example_id, passage_id, length(array_to_string(sentences, ' ')) AS size FROM ({_PASSAGES}) WHERE example_id IS NOT NULL),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY example_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT example_id, passage_id, least(size, 1200 - before)::BIGINT AS used FROM b WHERE before < 1200""",
    "events_per_minute": "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS requests, count(*) > 2 AS many FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "first_responses": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at NULLS LAST, response NULLS FIRST) AS i, count(*) OVER (PARTITION BY cache_key) AS writes FROM llm_responses WHERE cache_key IS NOT NULL)
SELECT cache_key, writes, sha256(response) AS digest FROM r WHERE i = 1""",
}
