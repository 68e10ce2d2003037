"""Corpora, suites and reports as files. Tables are written by Spark; only summaries of a row per system and metric reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON Lines per table."""
    for name, d in tables.items():
        d.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def canonical_rows(examples: DataFrame, facts: DataFrame, passages: DataFrame, dataset: str, seed: int) -> DataFrame:
    """The suite's rows: example, documents, sentence facts and gold facts, each example once.

    examples: example_id, question, answer (array), supporting_facts. facts: from sentence_facts. passages: passage_id,
    example_id, title, sentences. Facts of blank sentences are left out; gold facts keep the order of the examples.
    """
    docs = passages.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct(F.col("passage_id").alias("document_id"), "title", F.array_join("sentences", " ").alias("text")))).alias("documents"))
    whole = facts.where(F.col("sentence").rlike(r"\S"))
    each = whole.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct(F.col("passage_id").alias("document_id"), "sentence_index", "fact_id", F.col("sentence").alias("text")))).alias("facts"))
    gold = examples.select("example_id", F.posexplode("supporting_facts").alias("pos", "s")).select("example_id", "pos", "s.passage_id", "s.sentence_index")
    gold = gold.join(whole.select("example_id", "passage_id", "sentence_index", "fact_id"), ["example_id", "passage_id", "sentence_index"])
    gold = gold.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("pos", "fact_id"))).alias("g")).select("example_id", F.array_distinct("g.fact_id").alias("gold_fact_ids"))
    d = examples.join(docs, "example_id", "left").join(each, "example_id", "left").join(gold, "example_id", "left")
    return d.select(F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), "example_id", "question", F.col("answer")[0].alias("answer"), F.slice("answer", 2, 1000).alias("answer_aliases"), "documents", "facts", "gold_fact_ids")


def examples_of(rows: DataFrame) -> DataFrame:
    """The inverse of canonical_rows: example_id, question, answer, passages, supporting_facts.

    A passage's sentences are its document's facts in order, blank ones left out; supports are the places of the gold facts among them.
    """
    d = rows.withColumn("facts", F.coalesce("facts", F.array().cast(dict(rows.dtypes)["facts"]))).withColumn("documents", F.coalesce("documents", F.array().cast(dict(rows.dtypes)["documents"])))
    own = lambda doc: F.filter("facts", lambda f: (f["document_id"] == doc["document_id"]) & f["text"].rlike(r"\S"))
    passages = F.transform("documents", lambda doc: F.struct(doc["document_id"].alias("passage_id"), doc["title"].alias("title"), F.transform(own(doc), lambda f: f["text"]).alias("sentences")))
    placed = F.flatten(F.transform("documents", lambda doc: F.transform(own(doc), lambda f, i: F.struct(f["fact_id"].alias("fact_id"), doc["document_id"].alias("passage_id"), i.alias("sentence_index")))))
    d = d.withColumn("__p", placed)
    gold = F.transform(F.coalesce("gold_fact_ids", F.array().cast("array<string>")), lambda g: F.get(F.filter("__p", lambda x: x["fact_id"] == g), F.lit(0)))
    supports = F.transform(F.filter(gold, lambda x: x.isNotNull()), lambda x: F.struct(x["passage_id"].alias("passage_id"), x["sentence_index"].alias("sentence_index")))
    answer = F.array_compact(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>"))))
    return d.select("example_id", "question", answer.alias("answer"), passages.alias("passages"), supports.alias("supporting_facts"))


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """rows, ids_sha256: how many rows, and the SHA-256 of their sorted keys' SHA-256 sums added up (the same whatever their order)."""
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("ids_sha256"))


def value(mean: float | None, low: float | None = None, high: float | None = None, n: int | None = None) -> str:
    """``0.1234 [0.1, 0.2] (n=9)``, or ``N/A``."""
    if mean is None:
        return "N/A"
    interval = f" [{low:.4f}, {high:.4f}]" if low is not None and high is not None else ""
    return f"{mean:.4f}{interval}" + (f" (n={n})" if n is not None else "")


def markdown(summary: DataFrame, title: str, tables: dict[str, list[str]]) -> str:
    """A table per heading with a row per system and a column per metric. summary: system, metric, n, mean, ci95_low, ci95_high."""
    held = {(r.system, r.metric): r for r in summary.collect()}  # systems times metrics
    systems = sorted({s for s, _ in held})
    lines = [f"# {title}", ""]
    for head, metrics in tables.items():
        lines += [f"## {head}", "", "| System | " + " | ".join(metrics) + " |", "|---|" + "---:|" * len(metrics)]
        for s in systems:
            cells = [value(r["mean"], r["ci95_low"], r["ci95_high"], r["n"]) if (r := held.get((s, m))) else "N/A" for m in metrics]
            lines.append(f"| {s} | " + " | ".join(cells) + " |")
        lines.append("")
    return "\n".join(lines)


def write_report(records: DataFrame, summary: DataFrame, path: str, title: str, tables: dict[str, list[str]]) -> None:
    """records, summary and report.md (a one-line-per-row text file) below ``path``."""
    records.write.mode("overwrite").json(f"{path}/records")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    spark: SparkSession = records.sparkSession
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(markdown(summary, title, tables).split("\n"))], "i int, value string")
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/report.md")


def summarize_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """The rows of all summaries that match a pattern, with ``run``, the folder they lie in."""
    d = spark.read.json(pattern)
    return d.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/summary/[^/]*$", 1))
