"""Registered queries of the core over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.answers import answer_tokens, f1
from factweave.functions.text import unit_interval
from factweave.operators import corpus, external, facts, graph, limiter, ranking, stats, vectors
from factweave.plans import corpora, evaluation, retrieval, sql
from factweave.plans.common import gold, once
from factweave.sources.tables import table


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)).alias("content_id"))


def split_partition(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "benchmark_examples").select("example_id").where(F.col("example_id").isNotNull()).distinct()
    at = unit_interval(F.col("example_id"))
    return d.select("example_id", F.when(at < 0.7, "train").when(at < 0.85, "validation").otherwise("test").alias("part"))


def section_split(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.sections(table(spark, folder, "documents"), "doc_id", "text")


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus.windows(table(spark, folder, "documents"), "doc_id", "text", 64, 16)
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("tokens")).alias("tokens"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return corpus.bm25(table(spark, folder, "documents"), q)


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top(v, v.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"))


def _softmax(d: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / 0.05)
    return d.withColumn("e", e).select("query_id", "vec_id", F.round(F.col("e") / F.sum("e").over(w), 5).alias("weight"))


def seed_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Over the 5 nearest only, as its SQL; seed_weights_64 has all seeds."""
    return _softmax(dense_topk(spark, folder))


def seed_weights_64(spark: SparkSession, folder: str) -> DataFrame:
    """Over the 64 nearest, as the reference's build_seed_weights."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return _softmax(vectors.cosine_top(v, v.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), 64))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    d = ranking.rrf(table(spark, folder, "scored_facts"))
    return ranking.top(d, ["query_id"], [F.col("score").desc(), F.col("fact_id")], 20)


def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.symmetric(retrieval.incidence(spark, folder))
    return e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.sum("weight"), 4).alias("degree"))


def spectral_bands(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node"), (F.col("o_totalprice") / 1000).alias("v"))
    d = graph.bands(graph.symmetric(retrieval.incidence(spark, folder)), x)
    return d.select("node", *[F.round(c, 6).alias(c) for c in ("raw", "low", "mid", "high")])


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where(F.col("c_custkey") % 20 == 0).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))


def hop_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest seed's distance only, as its SQL; hop_reach_seeds has every seed's."""
    return graph.hops(graph.symmetric(retrieval.incidence(spark, folder)), _seeds(spark, folder))


def hop_reach_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return graph.seed_hops(graph.symmetric(retrieval.incidence(spark, folder)), _seeds(spark, folder))


def verify_evidence(spark: SparkSession, folder: str) -> DataFrame:
    e = once(table(spark, folder, "benchmark_examples"), "example_id").select("example_id", F.explode("supporting_facts").alias("s")).select("example_id", "s.passage_id", "s.sentence_index").distinct()
    d = facts.verified(e, once(table(spark, folder, "passages"), "passage_id"))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("links"))


def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    r = once(table(spark, folder, "baseline_results"), "result_id").select("result_id", "system", "example_id", "document_ranking")
    d = ranking.ranking_scores(r.join(gold(spark, folder), "example_id"), "document_ranking", "gold")
    return d.drop("dataset", "references", "gold", "document_ranking")


def answer_f1(spark: SparkSession, folder: str) -> DataFrame:
    r = once(table(spark, folder, "baseline_results"), "result_id").select("result_id", "system", "example_id", "answer")
    d = r.join(gold(spark, folder), "example_id").withColumn("a", answer_tokens(F.col("answer")))
    best = F.array_max(F.transform("references", lambda g: f1(F.col("a"), answer_tokens(g))))
    return d.select("result_id", "system", "example_id", F.round(best, 6).alias("f1"))


def summary_by_system(spark: SparkSession, folder: str) -> DataFrame:
    d = ranking_metrics(spark, folder).unpivot(["system"], ["mrr", "recall_5", "ndcg_5", "precision_5"], "metric", "value")
    return d.groupBy("system", "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def paired_cohen(spark: SparkSession, folder: str) -> DataFrame:
    each = answer_f1(spark, folder).groupBy("example_id", "system").agg(F.avg("f1").alias("f1"))
    a, b = each.toDF("example_id", "system_a", "fa"), each.toDF("example_id", "system_b", "fb")
    d = a.join(b, "example_id").where("system_a < system_b").withColumn("d", F.round(F.col("fa") - F.col("fb"), 9))
    g = d.groupBy("system_a", "system_b").agg(F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("difference"), F.round(F.nanvl(stats.cohens_d("d"), F.lit(None).cast("double")), 5).alias("cohens_d"))
    return g


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "benchmark_examples").select("example_id").where(F.col("example_id").isNotNull()).distinct()
    d = external.audit(once(table(spark, folder, "baseline_results"), "result_id"), e)
    return d.select("system", "expected", "received", "missing", "succeeded", (F.col("received") - F.col("succeeded")).alias("failed"))


def external_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Of the distinct entries that are not blank, how many are passages of any example."""
    r = once(table(spark, folder, "baseline_results"), "result_id").select("result_id", F.explode(ranking.distinct_ranking(F.col("document_ranking"))).alias("passage_id"))
    p = table(spark, folder, "passages").select("passage_id").distinct().withColumn("known", F.lit(1))
    d = r.join(p, "passage_id", "left").groupBy("result_id").agg(F.count(F.lit(1)).alias("entries"), F.count("known").alias("mapped"))
    return d.withColumn("coverage", F.round(F.col("mapped") / F.col("entries"), 6))


def canonical_entities(spark: SparkSession, folder: str) -> DataFrame:
    e = once(table(spark, folder, "benchmark_examples"), "example_id")
    e = e.select("example_id", F.explode("bridge_entities").alias("name")).select("name", F.lit("bridge").alias("entity_type"), F.col("example_id").alias("at"))
    d = facts.canonical_entities(e)
    return d.select("entity_type", "entity", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "mentions")


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    p = once(table(spark, folder, "passages"), "passage_id").where(F.col("example_id").isNotNull())
    d = p.select("example_id", "passage_id", F.length(F.array_join("sentences", " ")).alias("size"))
    w = W.partitionBy("example_id").orderBy("passage_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("before") < 1200)
    return d.select("example_id", "passage_id", F.least(F.col("size"), 1200 - F.col("before")).cast("bigint").alias("used"))


def events_per_minute(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user by calendar minute; limiter_sliding has the reference's trailing window."""
    d = table(spark, folder, "events").groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return d.select("user_id", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > 2).alias("many"))


def limiter_sliding(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "events").where(F.col("ts").isNotNull())
    d = d.select("event_id", "user_id", "ts", limiter.micros(d, "ts").alias("at"))
    d = limiter.admitted(limiter.trailing(d, "user_id", "at", 60_000_000), "user_id", "at", "event_id", 2, 60_000_000)
    return d.select("event_id", "user_id", "ts", "trailing", "admitted")


def first_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Of each key the response that was written first (of the same time, the least)."""
    d = table(spark, folder, "llm_responses").where(F.col("cache_key").isNotNull())
    first = F.min_by(F.struct("response"), F.struct(F.col("created_at").isNull(), "created_at", "response"))
    return d.groupBy("cache_key").agg(F.count(F.lit(1)).alias("writes"), F.sha2(first["response"], 256).alias("digest"))


QUERIES = {f.__name__: f for f in (
    document_ids, split_partition, section_split, chunk_counts, bm25_topk, dense_topk, seed_weights, seed_weights_64, rrf_fusion, graph_degree, spectral_bands, hop_reach, hop_reach_seeds, verify_evidence,
    ranking_metrics, answer_f1, summary_by_system, paired_cohen, audit_counts, external_mapping, canonical_entities, context_budget, events_per_minute, limiter_sliding, first_responses)}
QUERIES |= evaluation.QUERIES | corpora.QUERIES | retrieval.QUERIES
SQL = sql.SQL | evaluation.SQL | corpora.SQL | retrieval.SQL
