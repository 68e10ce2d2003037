"""Entities and facts from chunks by a client that answers in JSON, checked against the chunks.

A client is a function from a list of prompts to a list of answers; it runs in the tasks, batch by batch. Prompts
that are alike are sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import compact, confidence, grounded, normalize_name, repaired_json, short_id, slug

Client = Callable[[list[str]], list[str]]


def completed(prompts: DataFrame, prompt: str, client: Client) -> DataFrame:
    """Adds ``answer`` to the rows with a prompt; each distinct prompt is sent once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(client(b.column(0).to_pylist()), pa.string())], names=[prompt, "answer"])

    asked = prompts.select(prompt).where(F.col(prompt).isNotNull()).distinct()
    return prompts.join(asked.mapInArrow(ask, f"`{prompt}` string, answer string"), prompt)


def _object(answer: str) -> Column:
    return F.try_parse_json(repaired_json(answer))


def entities(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """entity_id, entity, entity_type, canonical_name, description, mentions (chunk_id, surface) from answers {"entities": [...]}.

    chunks: chunk_id, text. answers: chunk_id, answer. Of names alike the first by chunk gives name; the first description that
    is not blank stays. Mentions are the names that the chunk's text holds.
    """
    d = answers.select("chunk_id", F.posexplode(F.try_variant_get(_object("answer"), "$.entities", "array<variant>")).alias("pos", "v"))
    get = lambda k: compact(F.try_variant_get("v", f"$.{k}", "string"))
    d = d.select("chunk_id", "pos", get("name").alias("name"), slug(get("type"), "entity").alias("entity_type"), get("description").alias("description")).where(F.col("name") != "")
    d = d.withColumn("entity", normalize_name("name")).where(F.col("entity") != "").join(chunks.select("chunk_id", "text"), "chunk_id")
    at = F.struct("chunk_id", "pos")
    held = F.when(F.contains(F.lower("text"), F.lower("name")), F.struct("chunk_id", F.col("name").alias("surface")))
    said = F.when(F.col("description") != "", F.col("description"))
    d = d.groupBy("entity", "entity_type").agg(F.min_by("name", at).alias("canonical_name"), F.min_by(said, F.when(said.isNotNull(), at)).alias("description"), F.sort_array(F.collect_set(held)).alias("mentions"))
    return d.select(short_id("ent", F.concat_ws(":", "entity_type", "entity"), 12).alias("entity_id"), "*")


def facts(chunks: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """fact_id, predicate, arguments, evidence, chunk_id, confidence from answers {"facts": [...]}.

    known: entity_id. A fact stays if its evidence stands in its chunk (whatever the whitespace) and it has two known entities or
    more; of equal facts the surest stays, of these the first by chunk.
    """
    d = answers.select("chunk_id", F.posexplode(F.try_variant_get(_object("answer"), "$.facts", "array<variant>")).alias("pos", "v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    d = d.select("chunk_id", "pos", compact(get("predicate")).alias("predicate"), get("evidence").alias("quote"), confidence(get("confidence")).alias("confidence"), F.try_variant_get("v", "$.arguments", "array<struct<role string, entity_id string>>").alias("arguments"))
    d = d.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("evidence", grounded("text", "quote")).where(F.col("evidence").isNotNull() & (F.col("predicate") != ""))
    one = d.select("chunk_id", "pos", F.posexplode("arguments").alias("i", "a")).select("chunk_id", "pos", "i", slug(F.col("a.role"), "argument").alias("role"), F.col("a.entity_id").alias("entity_id"))
    one = one.join(known.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("chunk_id", "pos", "role", "entity_id").agg(F.min("i").alias("i"))
    one = one.groupBy("chunk_id", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "role", "entity_id"))).alias("x"), F.count_distinct("entity_id").alias("n")).where("n >= 2")
    one = one.select("chunk_id", "pos", F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["entity_id"].alias("entity_id"))).alias("arguments"))
    d = d.drop("arguments").join(one, ["chunk_id", "pos"])
    d = d.withColumn("fact_id", short_id("fact", F.to_json(F.struct("predicate", "arguments", "evidence")), 12))
    best = F.max_by(F.struct("predicate", "arguments", "evidence", "chunk_id", "confidence"), F.struct("confidence", (-F.col("pos")).alias("p")))
    return d.groupBy("fact_id").agg(best.alias("b")).select("fact_id", "b.*")


def coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """case, expected, covered: expected facts (case, fact, name) all of whose names one found fact (case, fact_id, names) holds.

    A name is held if it equals one of the fact's names or one is part of the other, beyond case.
    """
    e = expected.groupBy("case", "fact").agg(F.collect_set(F.lower("name")).alias("want"))
    like = lambda a: F.exists("have", lambda b: F.contains(a, b) | F.contains(b, a))
    d = e.join(found.select("case", "fact_id", F.transform("names", F.lower).alias("have")), "case", "left")
    hit = d.groupBy("case", "fact").agg(F.coalesce(F.bool_or(F.forall("want", like)), F.lit(False)).alias("hit"))
    return hit.groupBy("case").agg(F.count(F.lit(1)).alias("expected"), F.count_if("hit").alias("covered"))
