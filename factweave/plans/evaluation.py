"""Scores, summaries and tests of systems, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.answers import answer_scores, answer_tokens, citation_ids, citation_status
from factweave.functions import text
from factweave.functions.text import category_key
from factweave.operators import external, ranking, stats
from factweave.plans.common import EXAMPLES, PASSAGES, RESULTS, examples, gold, once, passages, results
from factweave.session import cut
from factweave.sources.tables import table

_CLOSED = "('yes', 'no', 'noanswer')"
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '\[fact_[^\]]*\]', ' ', 'g')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
_ANSWERS = f"""
SELECT result_id, system, example_id, max(s) AS s FROM (
  SELECT *, {{'f1': CASE WHEN a = b THEN 1.0::DOUBLE WHEN zero THEN 0 ELSE 2.0 * c / (len(a) + len(b)) END, 'em': (a = b)::INT::DOUBLE,
    'recall': CASE WHEN a = b THEN 1.0::DOUBLE WHEN zero THEN 0 ELSE c / len(b)::DOUBLE END, 'precision': CASE WHEN a = b THEN 1.0::DOUBLE WHEN zero THEN 0 ELSE c / len(a)::DOUBLE END}} AS s
  FROM (SELECT *, len(a) = 0 OR len(b) = 0 OR (len(a) = 1 AND a[1] IN {_CLOSED}) OR (len(b) = 1 AND b[1] IN {_CLOSED}) AS zero,
      coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda y: y = w))))), 0)::DOUBLE AS c
    FROM (SELECT r.result_id, r.system, r.example_id, {_TOKENS.format("r.answer")} AS a, {_TOKENS.format("e.ref")} AS b
      FROM ({RESULTS}) r JOIN (SELECT example_id, unnest(CASE WHEN len(answer) > 0 THEN answer ELSE [''] END) AS ref FROM ({EXAMPLES})) e USING (example_id))))
GROUP BY ALL"""
_GOLD = f"SELECT example_id, dataset, list_distinct(list_filter([s.passage_id FOR s IN supporting_facts], lambda x: x IS NOT NULL)) AS g FROM ({EXAMPLES})"
_SETS = f"""
SELECT result_id, system, r.example_id, dataset, CASE WHEN g > 0 THEN (n = p AND n = g)::INT::DOUBLE END AS em, CASE WHEN g > 0 THEN CASE WHEN p > 0 THEN n / p::DOUBLE ELSE 0 END END AS precision,
  CASE WHEN g > 0 THEN n / g::DOUBLE END AS recall, CASE WHEN g > 0 THEN 2.0 * n / (p + g)::DOUBLE END AS f1
FROM (SELECT result_id, system, r.example_id, e.dataset, len(e.g) AS g, len(c) AS p, len(list_intersect(c, e.g)) AS n
  FROM (SELECT *, list_distinct(list_filter(coalesce(citations, []), lambda x: x IS NOT NULL)) AS c FROM ({RESULTS})) r JOIN ({_GOLD}) e USING (example_id)) r"""
_KEY = r"nullif(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g'), '')"


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    r = results(spark, folder).select("result_id", "system", "example_id", "answer")
    d = r.join(gold(spark, folder), "example_id")
    return d.select("result_id", "system", "example_id", "dataset", answer_scores(answer_tokens(F.col("answer")), F.col("references")).alias("s"))


def answer_tuples(spark: SparkSession, folder: str) -> DataFrame:
    d = _answers(spark, folder)
    return d.select("result_id", "system", "example_id", *[F.round(F.col("s")[c], 6).alias(c) for c in ("em", "precision", "recall", "f1")])


def _supports(spark: SparkSession, folder: str) -> DataFrame:
    r = results(spark, folder).select("result_id", "system", "example_id", "citations")
    d = r.join(gold(spark, folder), "example_id")
    return d.select("result_id", "system", "example_id", "dataset", ranking.set_scores(F.col("citations"), F.col("gold")).alias("s"))


def set_scores(spark: SparkSession, folder: str) -> DataFrame:
    d = _supports(spark, folder)
    return d.select("result_id", "system", "example_id", *[F.round(F.col("s")[c], 6).alias(c) for c in ("em", "precision", "recall", "f1")])


def official_joint(spark: SparkSession, folder: str) -> DataFrame:
    """By data set: answers and supports where it scores them, their joint scores for hotpotqa only."""
    s = _supports(spark, folder).select("result_id", F.col("s").alias("support"))
    d = _answers(spark, folder).withColumnRenamed("s", "answer").join(s, "result_id").withColumn("name", F.replace(category_key(F.col("dataset")), F.lit("_"), F.lit("")))
    j = ranking.joint(F.col("answer"), F.col("support"))
    scored, both = F.col("name").isin("hotpotqa", "musique", "2wikimultihopqa"), F.col("name") == "hotpotqa"
    return d.select(
        "result_id", "name", F.round(F.when(scored, F.col("answer.f1")), 6).alias("answer_f1"), F.round(F.when(scored, F.col("support.f1")), 6).alias("support_f1"),
        *[F.round(F.when(both, j[c]), 6).alias(f"joint_{c}") for c in ("em", "precision", "recall", "f1")],
    )


def cited_facts(spark: SparkSession, folder: str) -> DataFrame:
    r = results(spark, folder).withColumn("ids", citation_ids(F.col("answer")))
    return r.select("result_id", F.size("ids").alias("cited"), F.array_join("ids", "|").alias("ids"))


def citation_states(spark: SparkSession, folder: str) -> DataFrame:
    """Citations are valid if they are passages of the example; labels in brackets that name nothing are a failed parse."""
    p = passages(spark, folder).select("example_id", F.col("passage_id").alias("c")).withColumn("known", F.lit(1))
    r = results(spark, folder).join(gold(spark, folder), "example_id")
    each = r.select("result_id", "example_id", F.explode(F.array_distinct("citations")).alias("c")).join(p, ["example_id", "c"], "left").groupBy("result_id").agg(F.count(F.lit(1)).alias("received"), F.count("known").alias("valid"))
    d = r.join(each, "result_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("received", "valid")})
    labels = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[([^\[\]]+)\]"), 1), lambda x: F.trim(x))
    failed = (F.col("received") == 0) & F.exists(labels, lambda x: ~x.rlike("^[0-9]+$"))
    has = F.size(F.array_compact("gold")) > 0
    return d.select("result_id", citation_status(F.col("status"), F.col("received"), F.col("valid"), F.col("received") - F.col("valid"), has, failed).alias("citation_status"))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """system, metric, example_id, value: answer F1 and support F1, a mean over the attempts."""
    both = _answers(spark, folder).select("result_id", "system", "example_id", F.col("s.f1").alias("answer_f1")).join(_supports(spark, folder).select("result_id", F.col("s.f1").alias("support_f1")), "result_id")
    d = both.unpivot(["system", "example_id"], ["answer_f1", "support_f1"], "metric", "v")
    return d.groupBy("system", "metric", "example_id").agg(F.avg("v").alias("value"))


def holm_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two systems by metric on the examples that all have: mean difference, bound of the p-value, adjusted over all of them."""
    d = stats.pair_differences(_metrics(spark, folder), "system", "example_id", "value", ["metric"])
    d = d.groupBy("metric", "system_a", "system_b").agg(F.count("d").alias("n"), F.avg("d").alias("difference"), stats.cohens_d("d").alias("cohens_d"))
    d = d.withColumn("p", stats.hoeffding_p(F.col("n"), F.col("difference"))).withColumn("k", F.concat_ws("|", "metric", "system_a", "system_b"))
    d = stats.holm(d, "p", "k", "adjusted")
    return d.select("metric", "system_a", "system_b", "n", *[F.round(c, 6).alias(c) for c in ("difference", "p", "adjusted")])


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return stats.summarize(_metrics(spark, folder), ["system", "metric"], "example_id", "value")


def randomization_p(spark: SparkSession, folder: str) -> DataFrame:
    d = stats.pair_differences(_metrics(spark, folder), "system", "example_id", "value", ["metric"])
    return stats.randomization_p(d, ["metric", "system_a", "system_b"], "example_id", permutations=1000)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of a system at an example as runs, numbered by time."""
    w = W.partitionBy("system", "example_id").orderBy("finished_at", "result_id")
    r = results(spark, folder).select("result_id", F.row_number().over(w).alias("run"))
    return answer_tuples(spark, folder).join(r, "result_id").where(F.col("run") <= 2)


def run_collapse(spark: SparkSession, folder: str) -> DataFrame:
    d = stats.collapse_runs(_runs(spark, folder), ["system", "example_id"], "run", ["em", "f1"], 2)
    return d.select("system", "example_id", "complete", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


def run_variation(spark: SparkSession, folder: str) -> DataFrame:
    d = stats.run_variation(_runs(spark, folder), ["system"], "run", "f1")
    return d.select("system", "runs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def failure_rates(spark: SparkSession, folder: str) -> DataFrame:
    d = results(spark, folder).groupBy("system").agg(F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("k"), F.count(F.lit(1)).alias("n"))
    return d.select("system", F.format_string("%.2f%% (%d/%d)", F.round(100.0 * F.col("k") / F.col("n"), 2), "k", "n").alias("failed"))


def latency(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the seconds of a system, and how many results an hour they make."""
    r = results(spark, folder).where(F.col("total_seconds").isNotNull() & ~F.isnan("total_seconds"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY total_seconds)")
    return r.groupBy("system").agg(F.count(F.lit(1)).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(3600.0 * F.count(F.lit(1)) / F.nullif(F.sum("total_seconds"), F.lit(0.0)), 4).alias("per_hour"))


def external_rankings(spark: SparkSession, folder: str) -> DataFrame:
    return external.normalized_ranking(results(spark, folder), passages(spark, folder))


def external_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return external.coverage(external_rankings(spark, folder))


def external_audit(spark: SparkSession, folder: str) -> DataFrame:
    return external.audit(results(spark, folder), examples(spark, folder).select("example_id"))


def protocol_contract(spark: SparkSession, folder: str) -> DataFrame:
    return external.contract(results(spark, folder), "generation_protocol", "shared_v2")


def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    r = results(spark, folder)
    return external.unfinished(r, examples(spark, folder), r.agg(F.count_distinct("system")).first()[0])


def validation_gates(spark: SparkSession, folder: str) -> DataFrame:
    """gate, violations: what a strict load would raise for."""
    r, e, p = table(spark, folder, "baseline_results"), table(spark, folder, "benchmark_examples"), table(spark, folder, "passages")
    repeated = lambda d, k: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = once(e, "example_id").select("example_id", F.explode("supporting_facts").alias("s")).select(F.col("s.passage_id").alias("passage_id"))
    gates = {
        "repeated_result": repeated(r, "result_id"), "repeated_example": repeated(e, "example_id"), "repeated_passage": repeated(p, "passage_id"),
        "unknown_example": once(r, "result_id").join(e.select("example_id"), "example_id", "left_anti"), "unknown_support": links.join(p.select("passage_id"), "passage_id", "left_anti"),
        "success_without_ranking": once(r, "result_id").where((F.col("status") == "success") & (F.coalesce(F.size("document_ranking"), F.lit(0)) <= 0)),
        "coverage_out_of_range": once(r, "result_id").where((F.col("mapping_coverage") < 0) | (F.col("mapping_coverage") > 1)),
    }
    parts = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(g).alias("gate"), "violations") for g, d in gates.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def expected_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every system at every example: its first result's scores. Missing, failed and unscorable results count 0 where there is gold."""
    e = gold(spark, folder)
    d = external.expected_results(results(spark, folder).select("system", "example_id", "result_id", "status", "answer", "citations", "document_ranking"), e, "result_id").join(e, "example_id")
    d = ranking.ranking_scores(d, "document_ranking", "gold")
    lost = ~F.coalesce(F.col("status") == "success", F.lit(False))
    a, c = answer_scores(answer_tokens(F.col("answer")), F.col("references")), ranking.set_scores(F.col("citations"), F.col("gold"))
    zero = lambda x: F.round(F.when(lost & x.isNotNull(), 0.0).otherwise(x), 6)
    named = {"passage_recall_5": F.col("recall_5"), "passage_ndcg_5": F.col("ndcg_5"), "answer_f1": a["f1"], "citation_f1": c["f1"], "joint_f1": ranking.joint(a, c)["f1"]}
    return d.select("system", "example_id", "status", *[zero(x).alias(k) for k, x in named.items()])


def metric_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Means of the expected scores, by the part of the work that a metric measures."""
    names = ["passage_recall_5", "passage_ndcg_5", "answer_f1", "citation_f1", "joint_f1"]
    d = expected_scores(spark, folder).unpivot(["system"], names, "metric", "value")
    part = F.when(F.col("metric").startswith("passage"), "retrieval").when(F.col("metric").startswith("citation"), "evidence").otherwise("generation")
    return d.groupBy("system", part.alias("category"), "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def known_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Answers without the labels of their citations and of the example's passages."""
    p = passages(spark, folder).groupBy("example_id").agg(F.concat(F.collect_set("passage_id"), F.collect_set("title")).alias("labels"))
    r = results(spark, folder).select("result_id", "example_id", "answer", "citations").join(p, "example_id", "left")
    labels = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("citations", "labels")])
    return r.select("result_id", text.without_labels(F.col("answer"), labels).alias("bare"))


def marked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Passages by where an answer first names the first word of their title."""
    p = passages(spark, folder).select("example_id", F.col("passage_id").alias("document_id"), F.substring_index("title", " ", 1).alias("marker"))
    return external.marked_ranking(results(spark, folder).select("result_id", "example_id", F.col("answer").alias("text")), p)


def evidence_units(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the ranked passages in first-seen order, unknown passages kept at their places."""
    d = external_rankings(spark, folder).withColumnRenamed("candidate", "fact_id")
    return external.units_of(d, passages(spark, folder).select(F.col("passage_id").alias("fact_id"), F.col("source_uri").alias("unit")), "__unmapped_fact__:")


def throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds a result by system, and the hours that 1000 examples would take."""
    d = results(spark, folder).groupBy("system").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in ("indexing_seconds", "retrieval_seconds", "total_seconds")])
    return d.select("*", F.round(text.ratio(F.col("total_seconds"), F.col("n")), 6).alias("each"), F.round(text.ratio(F.col("total_seconds") * 1000, F.col("n") * 3600), 6).alias("hours_per_1000"))


def paired_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every two systems by metric: examples, means, difference, its interval, effect, p-value, and this adjusted over all of them."""
    v = _metrics(spark, folder)
    d = cut(stats.pair_differences(v, "system", "example_id", "value", ["metric"]))
    by = ["metric", "system_a", "system_b"]
    each = d.groupBy(*by).agg(stats.cohens_d("d").alias("cohens_d"))
    ci = stats.summarize(d, by, "example_id", "d").withColumnRenamed("mean", "difference").drop("sd")
    p = stats.randomization_p(d, by, "example_id", permutations=1000)
    out = ci.join(each, by).join(p, by).withColumn("k", F.concat_ws("|", *by))
    return stats.holm(out, "p", "k", "adjusted").drop("k").withColumn("cohens_d", F.nanvl("cohens_d", F.lit(None).cast("double")))


def normalized_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of a result as passages of its example, by id or title, each once; how many map to none."""
    r = results(spark, folder).select("result_id", "example_id", F.col("citations").alias("document_ranking"))
    d = external.normalized_ranking(r, passages(spark, folder))
    known = ~F.col("candidate").startswith(external.UNMAPPED)
    return d.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("rank", "candidate")))), lambda x: x["candidate"]), "|").alias("mapped"), F.count_if(~known).alias("unmapped"))


QUERIES = {f.__name__: f for f in (
    paired_statistics, normalized_citations, expected_scores, metric_categories, known_labels, marked_documents, evidence_units, throughput, answer_tuples, set_scores, official_joint, cited_facts, citation_states, holm_pairs, bootstrap_ci, randomization_p, run_collapse, run_variation, failure_rates, latency,
    external_rankings, external_coverage, external_audit, protocol_contract, resume_antijoin, validation_gates)}

_PAIRS = f"""
j AS (SELECT a.system, a.example_id, a.s.f1 AS answer_f1, s.f1 AS support_f1 FROM ({_ANSWERS}) a JOIN ({_SETS}) s USING (result_id)),
v AS (SELECT system, example_id, 'answer_f1' AS metric, avg(answer_f1) AS v FROM j GROUP BY ALL UNION ALL SELECT system, example_id, 'support_f1', avg(support_f1) FROM j GROUP BY ALL),
n AS (SELECT metric, count(DISTINCT system) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT metric, example_id FROM v JOIN n USING (metric) WHERE v IS NOT NULL GROUP BY metric, example_id, n HAVING count(*) = n),
d AS (SELECT a.metric, a.system AS system_a, b.system AS system_b, round(a.v - b.v, 9) AS d FROM v a JOIN v b ON a.metric = b.metric AND a.example_id = b.example_id AND a.system < b.system JOIN k ON k.metric = a.metric AND k.example_id = a.example_id)"""
_RUNS = f"SELECT a.system, a.example_id, round(a.s.em, 6) AS em, round(a.s.f1, 6) AS f1, run FROM ({_ANSWERS}) a JOIN (SELECT result_id, row_number() OVER (PARTITION BY system, example_id ORDER BY finished_at NULLS FIRST, result_id) AS run FROM ({RESULTS})) USING (result_id) WHERE run <= 2"
_RANKING = f"""
u AS (SELECT result_id, example_id, unnest(document_ranking) AS entry, generate_subscripts(document_ranking, 1) AS pos FROM ({RESULTS})),
p AS ({PASSAGES}), t AS (SELECT example_id, title, min(passage_id) AS i FROM p WHERE title IS NOT NULL GROUP BY ALL),
m AS (SELECT result_id, pos, coalesce(p.passage_id, t.i, CASE WHEN coalesce(entry, '') LIKE '\\_\\_unmapped\\_\\_:%' ESCAPE '\\' THEN entry ELSE '__unmapped__:' || coalesce(entry, '') END) AS candidate
  FROM u LEFT JOIN p ON p.example_id = u.example_id AND p.passage_id = entry LEFT JOIN t ON t.example_id = u.example_id AND t.title = entry),
f AS (SELECT result_id, candidate, min(pos) AS pos FROM m GROUP BY ALL),
x AS (SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY pos))::INT AS rank, candidate FROM f)""".replace("\\\\", "\\")

_EXPECTED = f"""
WITH y AS (SELECT DISTINCT system FROM ({RESULTS}) WHERE system IS NOT NULL), w AS (SELECT e.example_id, e.g, y.system FROM ({_GOLD}) e, y),
f AS (SELECT w.*, r.result_id, CASE WHEN r.result_id IS NULL THEN 'missing' ELSE r.status END AS status FROM w LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, example_id ORDER BY result_id) AS i FROM ({RESULTS})) WHERE i = 1) r USING (system, example_id)),
v AS (SELECT result_id, p, min(pos) AS pos FROM (SELECT result_id, unnest(document_ranking) AS p, generate_subscripts(document_ranking, 1) AS pos FROM ({RESULTS})) WHERE p IS NOT NULL AND regexp_matches(p, '\\S') GROUP BY ALL),
k AS (SELECT result_id, p, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS pos FROM v),
h AS (SELECT f.result_id, count(*) AS n, sum(1 / log2(k.pos + 1)) AS d FROM f JOIN k ON k.result_id = f.result_id WHERE k.pos <= 5 AND list_contains(f.g, k.p) GROUP BY ALL),
z AS (SELECT f.system, f.example_id, f.status, f.status IS DISTINCT FROM 'success' AS lost, len(f.g) AS g, h.n, h.d, a.s.f1 AS af, a.s.precision AS ap, a.s.recall AS ar, s.f1 AS sf, s.precision AS sp, s.recall AS sr FROM f LEFT JOIN h USING (result_id) LEFT JOIN ({_ANSWERS}) a USING (result_id) LEFT JOIN ({_SETS}) s USING (result_id)),
x AS (SELECT system, example_id, status, CASE WHEN g > 0 THEN CASE WHEN lost THEN 0 ELSE round(coalesce(n, 0) / g::DOUBLE, 6) END END AS passage_recall_5,
  CASE WHEN g > 0 THEN CASE WHEN lost THEN 0 ELSE round(round(coalesce(d, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(g, 5) + 1)]), 9), 6) END END AS passage_ndcg_5, CASE WHEN lost THEN 0 ELSE round(af, 6) END AS answer_f1,
  CASE WHEN g > 0 THEN CASE WHEN lost THEN 0 ELSE round(sf, 6) END END AS citation_f1, CASE WHEN g > 0 THEN CASE WHEN lost THEN 0 WHEN ap * sp + ar * sr > 0 THEN round(2 * ap * sp * ar * sr / (ap * sp + ar * sr), 6) ELSE 0 END END AS joint_f1 FROM z)"""

SQL = {
    "normalized_citations": f"WITH {_RANKING.replace('document_ranking', 'citations')} SELECT result_id, coalesce(string_agg(candidate, '|' ORDER BY rank) FILTER (NOT starts_with(candidate, '__unmapped__:')), '') AS mapped, count(*) FILTER (starts_with(candidate, '__unmapped__:')) AS unmapped FROM x GROUP BY ALL",
    "expected_scores": f"{_EXPECTED} SELECT * FROM x",
    "metric_categories": f"{_EXPECTED}, u AS (SELECT system, metric, value FROM x UNPIVOT INCLUDE NULLS (value FOR metric IN (passage_recall_5, passage_ndcg_5, answer_f1, citation_f1, joint_f1))) SELECT system, CASE WHEN metric LIKE 'passage%' THEN 'retrieval' WHEN metric LIKE 'citation%' THEN 'evidence' ELSE 'generation' END AS category, metric, count(value) AS n, round(avg(value), 6) AS mean FROM u GROUP BY ALL",
    "known_labels": f"""
WITH p AS (SELECT example_id, list(passage_id) || list(title) AS l FROM ({PASSAGES}) GROUP BY ALL),
r AS (SELECT result_id, coalesce(answer, '') AS answer, list_sort(list_distinct([{{'n': -length(x), 'x': x}} FOR x IN list_filter(coalesce(citations, []) || coalesce(l, []), lambda y: y IS NOT NULL)])) AS l FROM ({RESULTS}) LEFT JOIN p USING (example_id))
SELECT result_id, list_reduce(list_prepend(answer, [x.x FOR x IN l]), lambda a, x: replace(a, '[' || x || ']', ' ')) AS bare FROM r""",
    "marked_documents": f"""
WITH d AS (SELECT r.result_id, p.passage_id AS document_id, min(strpos(r.answer, split_part(p.title, ' ', 1))) AS seen FROM ({RESULTS}) r JOIN ({PASSAGES}) p USING (example_id) WHERE split_part(p.title, ' ', 1) <> '' AND strpos(r.answer, split_part(p.title, ' ', 1)) > 0 GROUP BY ALL)
SELECT result_id, document_id, (row_number() OVER (PARTITION BY result_id ORDER BY seen, document_id))::INT AS rank FROM d""",
    "evidence_units": f"WITH {_RANKING}, q AS (SELECT passage_id, source_uri FROM p), g AS (SELECT result_id, coalesce(source_uri, '__unmapped_fact__:' || candidate) AS unit, min(rank) AS first FROM x LEFT JOIN q ON q.passage_id = candidate GROUP BY ALL) SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY first, unit))::INT AS rank, unit FROM g",
    "throughput": f"WITH g AS (SELECT system, count(*) AS n, round(sum(indexing_seconds), 3) AS indexing_seconds, round(sum(retrieval_seconds), 3) AS retrieval_seconds, round(sum(total_seconds), 3) AS total_seconds FROM ({RESULTS}) GROUP BY ALL) SELECT *, round(coalesce(total_seconds / n, 0), 6) AS each, round(coalesce(total_seconds * 1000 / (n * 3600), 0), 6) AS hours_per_1000 FROM g",
    "answer_tuples": f"SELECT result_id, system, example_id, round(s.em, 6) AS em, round(s.precision, 6) AS precision, round(s.recall, 6) AS recall, round(s.f1, 6) AS f1 FROM ({_ANSWERS})",
    "set_scores": f"SELECT result_id, system, example_id, round(em, 6) AS em, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_SETS})",
    "official_joint": f"""
WITH j AS (SELECT a.result_id, replace({_KEY.format("s.dataset")}, '_', '') AS name, a.s.em AS ae, a.s.precision AS ap, a.s.recall AS ar, a.s.f1 AS af, s.em AS se, s.precision AS sp, s.recall AS sr, s.f1 AS sf FROM ({_ANSWERS}) a JOIN ({_SETS}) s USING (result_id)),
h AS (SELECT *, name IN ('hotpotqa', 'musique', '2wikimultihopqa') AS scored, name = 'hotpotqa' AS joined, ap * sp AS p, ar * sr AS r FROM j)
SELECT result_id, name, round(CASE WHEN scored THEN af END, 6) AS answer_f1, round(CASE WHEN scored THEN sf END, 6) AS support_f1, round(CASE WHEN joined THEN ae * se END, 6) AS joint_em,
  round(CASE WHEN joined THEN p END, 6) AS joint_precision, round(CASE WHEN joined THEN r END, 6) AS joint_recall, round(CASE WHEN joined THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p + r IS NOT NULL THEN 0 END END, 6) AS joint_f1 FROM h""",
    "cited_facts": rf"""
WITH u AS (SELECT result_id, [trim(x) FOR x IN regexp_extract_all(coalesce(answer, ''), '\[([^\[\]]+)\]', 1)] AS l FROM ({RESULTS})),
f AS (SELECT result_id, list_filter(l, lambda x: starts_with(x, 'fact_')) AS l FROM u),
d AS (SELECT result_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM f)
SELECT result_id, len(l)::INT AS cited, array_to_string(l, '|') AS ids FROM d""",
    "citation_states": rf"""
WITH r AS (SELECT r.*, e.g FROM ({RESULTS}) r JOIN ({_GOLD}) e USING (example_id)), p AS ({PASSAGES}),
c AS (SELECT result_id, count(*) AS received, count(p.passage_id) AS valid FROM (SELECT DISTINCT result_id, example_id, unnest(citations) AS c FROM r) u LEFT JOIN p ON p.example_id = u.example_id AND p.passage_id = u.c GROUP BY ALL),
s AS (SELECT r.result_id, status, len(g) > 0 AS has, coalesce(received, 0) AS received, coalesce(valid, 0) AS valid,
  len(list_filter([trim(x) FOR x IN regexp_extract_all(coalesce(answer, ''), '\[([^\[\]]+)\]', 1)], lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 0 AS labels FROM r LEFT JOIN c USING (result_id))
SELECT result_id, CASE WHEN NOT has THEN 'no_gold_evidence' WHEN status = 'missing' THEN 'result_missing' WHEN status IN ('failed', 'unscorable') THEN CASE WHEN received > valid THEN 'citation_mapping_failed' ELSE 'result_failed' END
  WHEN received = 0 AND labels THEN 'citation_parse_failed' WHEN received = 0 THEN 'citation_empty' WHEN received > valid AND valid = 0 THEN 'citation_invalid_id' WHEN received > valid THEN 'citation_mapping_failed' ELSE 'success' END AS citation_status FROM s""",
    "holm_pairs": f"""
WITH {_PAIRS}, g AS (SELECT metric, system_a, system_b, count(d) AS n, avg(d) AS m, least(1.0, 2 * exp(-count(d) * avg(d) * avg(d) / 2)) AS p FROM d GROUP BY ALL),
h AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, metric || '|' || system_a || '|' || system_b) + 1 AS left_over FROM g)
SELECT metric, system_a, system_b, n, round(m, 6) AS difference, round(p, 6) AS p, round(max(least(1.0, left_over * p)) OVER (ORDER BY p, metric || '|' || system_a || '|' || system_b ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h""",
    "run_collapse": f"""
WITH r AS ({_RUNS}), g AS (SELECT system, example_id, count(DISTINCT run) = 2 AS complete, avg(em) AS em, avg(f1) AS f1 FROM r GROUP BY ALL)
SELECT system, example_id, complete, round(CASE WHEN complete THEN em END, 6) AS em, round(CASE WHEN complete THEN f1 END, 6) AS f1 FROM g""",
    "run_variation": f"WITH r AS ({_RUNS}), m AS (SELECT system, run, avg(f1) AS m FROM r GROUP BY ALL) SELECT system, count(m) AS runs, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m GROUP BY ALL",
    "failure_rates": f"WITH g AS (SELECT system, count(*) FILTER (coalesce(status <> 'success', true)) AS k, count(*) AS n FROM ({RESULTS}) GROUP BY ALL) SELECT system, printf('%.2f%% (%d/%d)', round(100.0::DOUBLE * k / n, 2), k, n) AS failed FROM g",
    "latency": f"SELECT system, count(*) AS n, quantile_disc(total_seconds, 0.5) AS p50, quantile_disc(total_seconds, 0.95) AS p95, round(3600.0 * count(*) / nullif(sum(total_seconds), 0), 4) AS per_hour FROM ({RESULTS}) WHERE total_seconds IS NOT NULL AND NOT isnan(total_seconds) GROUP BY ALL",
    "external_rankings": f"WITH {_RANKING} SELECT * FROM x",
    "external_coverage": f"WITH {_RANKING} SELECT result_id, count(*) AS entries, count(*) FILTER (NOT starts_with(candidate, '__unmapped__:')) AS mapped, round(count(*) FILTER (NOT starts_with(candidate, '__unmapped__:')) / count(*)::DOUBLE, 6) AS coverage FROM x GROUP BY ALL",
    "external_audit": f"""
WITH e AS (SELECT example_id FROM ({EXAMPLES})), i AS (SELECT system, r.example_id, count(*) AS n, r.example_id IN (FROM e) AS g, coalesce(bool_or(status = 'success'), false) AS ok, coalesce(bool_or(status = 'unscorable'), false) AS un FROM ({RESULTS}) r GROUP BY ALL)
SELECT system, count(*) FILTER (g) AS received, count(*) FILTER (g AND n > 1) AS duplicates, count(*) FILTER (NOT coalesce(g, false)) AS unknown, count(*) FILTER (g AND ok) AS succeeded, count(*) FILTER (g AND NOT ok AND NOT un) AS failed, count(*) FILTER (g AND NOT ok AND un) AS unscorable,
  (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e) - count(*) FILTER (g) AS missing FROM i GROUP BY ALL""",
    "protocol_contract": f"SELECT system, count(*) AS rows, count(*) FILTER (coalesce(generation_protocol = 'shared_v2', false)) AS same, bool_and(coalesce(generation_protocol = 'shared_v2', false)) AS holds FROM ({RESULTS}) GROUP BY ALL",
    "resume_antijoin": f"WITH d AS (SELECT example_id FROM ({RESULTS}) WHERE status = 'success' GROUP BY ALL HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM baseline_results WHERE result_id IS NOT NULL)) SELECT example_id FROM ({EXAMPLES}) WHERE example_id NOT IN (SELECT example_id FROM d WHERE example_id IS NOT NULL)",
    "validation_gates": f"""
SELECT 'repeated_result' AS gate, count(*) AS violations FROM (SELECT result_id FROM baseline_results WHERE result_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated_example', count(*) FROM (SELECT example_id FROM benchmark_examples WHERE example_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated_passage', count(*) FROM (SELECT passage_id FROM passages WHERE passage_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unknown_example', count(*) FROM ({RESULTS}) r WHERE NOT EXISTS (SELECT 1 FROM benchmark_examples e WHERE e.example_id = r.example_id)
UNION ALL SELECT 'unknown_support', count(*) FROM (SELECT unnest(supporting_facts) AS s FROM ({EXAMPLES})) u WHERE NOT EXISTS (SELECT 1 FROM passages p WHERE p.passage_id = u.s.passage_id)
UNION ALL SELECT 'success_without_ranking', count(*) FROM ({RESULTS}) WHERE status = 'success' AND coalesce(len(document_ranking), 0) = 0
UNION ALL SELECT 'coverage_out_of_range', count(*) FROM ({RESULTS}) WHERE mapping_coverage < 0 OR mapping_coverage > 1""",
}
