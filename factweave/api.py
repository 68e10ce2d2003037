"""The package in five steps: a corpus, an index of its facts, retrieval, evaluation and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import corpus, facts, graph, ranking, stats
from factweave.session import cut
from factweave.sinks import report


@dataclass(frozen=True)
class Corpus:
    """Passages (passage_id, example_id, title, sentences), their sentence facts and entities."""

    passages: DataFrame
    facts: DataFrame
    entities: DataFrame

    @classmethod
    def of(cls, passages: DataFrame) -> Corpus:
        f = facts.sentence_facts(passages)
        e = f.select(F.explode("arguments").alias("a")).groupBy("a.entity_id").agg(F.min("a.name").alias("name"))
        return cls(passages, f, e)


@dataclass(frozen=True)
class Index:
    """Facts as they read (doc_id, text), and the graph of facts and entities, both written once."""

    corpus: Corpus
    texts: DataFrame
    edges: DataFrame


def build_index(c: Corpus) -> Index:
    texts = c.facts.select(F.col("fact_id").alias("doc_id"), F.concat_ws(" ", "title", "sentence").alias("text"))
    _, edges = graph.reified(c.facts.withColumn("confidence", F.lit(1.0)), c.entities)
    pairs = edges.select(F.col("dst").alias("entity"), F.col("src").alias("fact"), "weight")
    return Index(c, cut(texts), cut(graph.symmetric(pairs)))


def retrieve(index: Index, questions: DataFrame, k: int = 12, hops: bool = False) -> DataFrame:
    """query_id, fact_id, score, rank of the k best facts of each question (query_id, text); with ``hops`` reranked by the graph."""
    hits = corpus.bm25(index.texts, questions, k).select("query_id", F.col("doc_id").alias("object_id"), "score", "rank")
    if hops:
        hits = graph.rerank(hits.drop("rank"), index.edges)
    return hits.withColumnRenamed("object_id", "fact_id")


def passages(index: Index, hits: DataFrame) -> DataFrame:
    return ranking.passages_of(hits, index.corpus.facts.select("fact_id", "passage_id"))


def contexts(index: Index, hits: DataFrame, limit: int = 12) -> DataFrame:
    """query_id, facts, context of each question's facts."""
    d = hits.join(index.corpus.facts.select("fact_id", "title", "sentence"), "fact_id")
    d = d.select(F.col("query_id").alias("example_id"), "rank", "fact_id", "title", F.col("title").alias("section"), F.lit(None).cast("int").alias("page"), F.lit("states").alias("predicate"), "sentence")
    return facts.evidence_context(d, limit).withColumnRenamed("example_id", "query_id")


def evaluate(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of rankings (system, example_id, ranking) against gold (example_id, gold)."""
    return ranking.ranking_scores(rankings.join(gold, "example_id"), "ranking", "gold").drop("ranking", "gold")


def summarize(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """system, metric, n, mean, sd and interval."""
    return stats.summarize(scores.unpivot(["system", "example_id"], metrics, "metric", "value"), ["system", "metric"], "example_id", "value")


write_report = report.write_report
