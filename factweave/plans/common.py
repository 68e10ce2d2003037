"""Frames that several plans start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.tables import table

# the same as SQL
RESULTS = "SELECT DISTINCT ON (result_id) * FROM baseline_results WHERE result_id IS NOT NULL"
EXAMPLES = "SELECT DISTINCT ON (example_id) * FROM benchmark_examples WHERE example_id IS NOT NULL"
PASSAGES = "SELECT DISTINCT ON (passage_id) * FROM passages WHERE passage_id IS NOT NULL"


def once(df: DataFrame, key: str) -> DataFrame:
    """A record (same key) counts once; null keys not at all. Repeats are rows that appear again unchanged."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def results(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "baseline_results"), "result_id")


def examples(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "benchmark_examples"), "example_id")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "passages"), "passage_id")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """example_id, dataset, references (answers), gold (supporting passages)."""
    return examples(spark, folder).select("example_id", "dataset", F.col("answer").alias("references"), F.transform("supporting_facts", lambda s: s["passage_id"]).alias("gold"))
