"""Registered queries of the subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import category_key
from factweave.llm import language, leak, mix, neardup, pairs, sample, sentences, sql, topn
from factweave.session import cut
from factweave.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = topn.best_facts(table(spark, folder, "scored_facts"))
    passages = topn.best_passages(table(spark, folder, "baseline_results"))
    return facts.select(F.lit("fact").alias("kind"), "query_id", "source", "item_id").unionByName(
        passages.select(F.lit("document").alias("kind"), F.col("example_id").alias("query_id"), F.lit("document_ranking").alias("source"), "item_id")
    )


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Members and classes of the passages, cut before they are read several times."""
    each = cut(neardup.classes(neardup.passage_text(table(spark, folder, "passages")), "passage_id", "text"))
    return neardup.members_of(each, "passage_id"), each.select("class_id", "elements").dropDuplicates(["class_id"])


def _similar(found: DataFrame, records: int, least: float = 0.7) -> DataFrame:
    light = cut(neardup.anchored(found, *neardup.plan(records, least)))
    return cut(neardup.class_pairs(found, neardup.candidates(light, least), least))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, found = _copies(spark, folder)
    pairs = neardup.member_pairs(members, _similar(found, table(spark, folder, "passages").count()), "passage_id")
    return pairs.select(F.col("a").alias("passage_a"), F.col("b").alias("passage_b"))


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = _copies(spark, folder)
    return neardup.copies(members, "passage_id")


def _sampling(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, targets, filled leaves and categories of the three fields."""
    docs, examples = table(spark, folder, "documents"), table(spark, folder, "benchmark_examples")
    records = reduce(
        DataFrame.unionByName,
        (
            sample.records_of(docs, "doc_id", "documents.domain", F.col("domain"), F.col("source")),
            sample.records_of(examples, "example_id", "benchmark_examples.query_type", F.col("query_type"), F.col("dataset")),
            sample.records_of(examples, "example_id", "benchmark_examples.dataset", F.col("dataset"), F.col("query_type")),
        ),
    )
    records = cut(records)
    leaves = records.groupBy("field_name", "category", "leaf").agg(F.count(F.lit(1)).alias("n"))
    pool = records.groupBy("field_name").agg(F.count(F.lit(1)).alias("pool"))
    named = table(spark, folder, "sample_targets").withColumnRenamed("category", "named").withColumn("category", category_key(F.col("named")))
    need = cut(sample.needs(leaves, named, pool))
    filled = cut(sample.fill(leaves, need))
    return records, named, filled, sample.unmet(need, filled)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The targets whose quota passes, in part or whole, to cousins."""
    _, named, _, categories = _sampling(spark, folder)
    short = categories.where(F.col("targeted") & (F.col("unmet") > 0))
    return named.join(short, ["field_name", "category"], "left_semi").select("field_name", F.col("named").alias("category"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    _, _, filled, categories = _sampling(spark, folder)
    d = sample.report(categories, sample.allocate(filled, categories))
    return d.select("field_name", "category", "need", "available", "quota", "unmet")


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    records, _, filled, categories = _sampling(spark, folder)
    return sample.draw(records, sample.allocate(filled, categories)).select("field_name", "category", "record_id")


def _mixing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """Documents with tokens, targets, and the budget: all documents' tokens counted once."""
    docs = table(spark, folder, "documents").withColumn("source_key", category_key(F.col("source")))
    sized = cut(mix.with_tokens(docs, ["doc_id", "source_key"], "text"))
    return sized, mix.target_table(table(spark, folder, "mix_targets")), sized.agg(F.sum("tokens")).first()[0] or 0


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets, budget = _mixing(spark, folder)
    return mix.reached(mix.queue(sized, targets), targets, budget).where("short").select("source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets, budget = _mixing(spark, folder)
    return mix.shares(sized, targets, budget)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets, budget = _mixing(spark, folder)
    kept = mix.truncate(mix.queue(sized, targets), budget)
    return kept.sort("finish", "source", "doc_id", "round").select("doc_id", "source", "round", "tokens")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of a run whose shingles are all alike (similarity 1), and the words too."""
    found = leak.find_leaks(table(spark, folder, "documents"), leak.weighted(table(spark, folder, "eval_items")), least=1.0)
    return found.where("holds_run").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks of runs, and edited leaks of the size of an item."""
    docs, known = table(spark, folder, "documents"), cut(leak.weighted(table(spark, folder, "eval_items")))
    runs, edited = leak.find_leaks(docs, known), leak.find_leaks(docs, known, leak.ITEM, radius=2)
    return runs.unionByName(edited).groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"), F.max("holds_run").alias("holds_run"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    passages = table(spark, folder, "passages")
    return sentences.units(sentences.records(table(spark, folder, "sections"), passages), sentences.spaces_model(passages))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.Compression.fit(language.labelled_sample(docs))
    found = language.segments(docs, model, sentences.spaces_model(table(spark, folder, "passages")))
    return language.doubtful(cut(found)).drop("lang")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_segments(spark, folder).select("doc_id", "segment_no", F.col("language").alias("lang"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    each = cut(pairs.pairs_of(table(spark, folder, "baseline_results"), table(spark, folder, "benchmark_examples"), table(spark, folder, "llm_responses")))
    languages = language.Bayes().fit(language.labelled_sample(table(spark, folder, "documents")))
    return pairs.defects(each, languages, cut(pairs.word_counts(each)))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_copies": p3_copies, "p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample, "p5_found": p5_found, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_found": p7_found, "p7_report": p7_report, "p7_mix": p7_mix, "p8_found": p8_found, "p8_segments": p8_segments}

SQL: dict[str, str] = {"p1_found": sql.P1_FOUND, "p4_found": sql.P4_FOUND}
