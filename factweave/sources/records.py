"""Raw records, texts, corpora and pairs from files; JSON stays JSON (VARIANT) until an adapter reads it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.operators.corpus import sections

WRAPPERS = ("data", "examples", "instances", "rows")
TABLES = ("documents", "chunks", "entities", "facts")


def _first(spark: SparkSession, path: str) -> str:
    """The first character that is not whitespace."""
    line = spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"\S")).select(F.trim("value").substr(1, 1)).first()
    return line[0] if line else ""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Only a line feed ends a line: other line separators may stand inside a value."""
    return spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"\S")).select(F.parse_json("value").alias("raw"))


def _elements(whole: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The elements of a list, or of the first of ``keys`` that an object has; an object without them is one element."""
    inner = reduce(lambda a, k: F.coalesce(a, F.expr(f"try_variant_get(raw, '$.{k}', 'array<variant>')")), keys, F.expr("try_variant_get(raw, '$', 'array<variant>')"))
    return whole.select(F.explode(F.coalesce(inner, F.array("raw"))).alias("raw"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """raw: the records of a JSON Lines file, or of a JSON list or object of one of WRAPPERS; ``row`` wraps are taken off."""
    if path.endswith(".jsonl") or _first(spark, path) not in "[{" or _is_lines(spark, path):
        d = _lines(spark, path)
    else:
        d = _elements(spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("raw")), WRAPPERS)
    return d.select(F.coalesce(F.expr("try_variant_get(raw, '$.row', 'variant')"), F.col("raw")).alias("raw"))


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a whole JSON object and another line follows."""
    two = spark.read.text(path, lineSep="\n").where(F.col("value").rlike(r"\S")).select(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")).limit(2).collect()
    return len(two) == 2 and two[0][0]


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of a result file (JSON Lines, a list, or an object of records, results or data), and its manifest (no row if it has none)."""
    if path.endswith(".jsonl") or _is_lines(spark, path):
        rows = _lines(spark, path)
        return rows, rows.limit(0)
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("raw"))
    manifest = whole.select(F.expr("try_variant_get(raw, '$.manifest', 'variant')").alias("raw")).where(F.col("raw").isNotNull())
    return _elements(whole, ("records", "results", "data")), manifest


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, title, source_uri, text of .txt and .md files; other kinds, PDF among them, are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(kind.isin("txt", "md", "markdown"), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("unsupported document: "), "path")))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return files.select(F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 16)).alias("document_id"), name.alias("title"), F.col("path").alias("source_uri"), text.alias("text"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """document_id, section_no, title, text, start_char of the sections of documents; start_char counts section texts and one character after each."""
    d = sections(read_documents(spark, path), "document_id", "text")
    w = W.partitionBy("document_id").orderBy("section_no").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("start_char", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def read_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Two text columns of a CSV file with a header."""
    return spark.read.csv(path, header=True, schema=f"`{left}` string, `{right}` string", quote='"', escape='"')


def load_corpus(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a corpus folder, one folder of JSON Lines per table; ``schemas``: DDL of each."""
    return {name: spark.read.schema(schemas[name]).json(f"{path}/{name}") for name in schemas}
