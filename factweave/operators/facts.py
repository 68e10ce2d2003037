"""Facts from sentences, their entities and arguments, and how they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.text import concepts, normalize_name, short_id


def sentence_facts(passages: DataFrame) -> DataFrame:
    """One fact per stored sentence: example_id, passage_id, sentence_index, chunk_id, fact_id, sentence, start_char, title, arguments.

    passages: passage_id (unique), example_id, title, sentences. arguments are structs of role, entity_id and name: the title's
    entity as ``source``, up to eight concepts as ``mention``, and the sentence itself as ``statement`` where these are
    fewer than two entities. Null sentences and null examples count as empty.
    """
    title, example = F.coalesce("title", F.lit("")), F.coalesce("example_id", F.lit(""))
    each = F.transform("sentences", lambda s: F.coalesce(s, F.lit("")))
    d = passages.select(example.alias("example_id"), "passage_id", title.alias("title"), each.alias("__s"))
    d = d.select("example_id", "passage_id", "title", "__s", F.posexplode("__s").alias("sentence_index", "sentence"))
    before = F.aggregate(F.slice("__s", 1, F.col("sentence_index")), F.lit(0), lambda n, s: n + F.length(s) + 1)
    d = d.withColumn("start_char", before).withColumn("chunk_id", short_id("chunk", F.concat_ws(":", "example_id", "passage_id", "sentence_index")))
    argument = lambda role, i, name: F.struct(F.lit(role).alias("role"), i.alias("entity_id"), name.alias("name"))
    source = argument("source", short_id("ent", F.concat(F.lit("title:"), F.lower("title"))), F.col("title"))
    mentions = F.transform(concepts(F.col("sentence"), F.col("title")), lambda c: argument("mention", short_id("ent", F.concat(F.lit("concept:"), F.lower(c))), c))
    statement = argument("statement", short_id("ent", F.concat(F.lit("sentence:"), "chunk_id")), F.concat(F.lit("sentence "), "sentence_index"))
    found = F.concat(F.array(source), mentions)
    found = F.when(distinct_entities(found) < 2, F.concat(found, F.array(statement))).otherwise(found)
    return d.select("example_id", "passage_id", "sentence_index", "chunk_id", short_id("fact", F.col("chunk_id")).alias("fact_id"), "sentence", "start_char", "title", found.alias("arguments"))


def distinct_entities(arguments: Column) -> Column:
    return F.size(F.array_distinct(F.transform(arguments, lambda a: a["entity_id"])))


def valid_arguments(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """fact_id, arguments: those of known entities, each (role, entity_id) once, of facts with two entities or more.

    facts: fact_id, arguments. entities: entity_id (unique).
    """
    d = facts.select("fact_id", F.posexplode("arguments").alias("pos", "a")).withColumn("entity_id", F.col("a.entity_id"))
    d = d.join(entities.select("entity_id"), "entity_id", "left_semi")
    d = d.groupBy("fact_id", "a.role", "entity_id").agg(F.min(F.struct("pos", "a")).alias("m"))
    d = d.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["a"]).alias("arguments"))
    return d.where(distinct_entities(F.col("arguments")) >= 2)


def verbalized(predicate: Column, arguments: Column, qualifiers: Column | None = None) -> Column:
    """``predicate: role=name, ...; key=value, ...``; an argument without a name shows its id, null qualifiers are left out."""
    named = F.array_join(F.transform(arguments, lambda a: F.concat(a["role"], F.lit("="), F.coalesce(a["name"], a["entity_id"]))), ", ")
    text = F.concat(predicate, F.lit(": "), named)
    if qualifiers is None:
        return text
    held = F.array_join(F.transform(F.map_entries(F.map_filter(qualifiers, lambda k, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return F.when(held != "", F.concat(text, F.lit("; "), held)).otherwise(text)


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """entity_type, entity, canonical_name (of the first mention), aliases (all spellings, sorted), mentions (how many).

    mentions: name, entity_type, at (orders the mentions). Names that are alike after normalize_name are one entity.
    """
    d = mentions.where(F.col("name").rlike(r"\S")).withColumn("entity", normalize_name("name"))
    d = d.groupBy("entity_type", "entity", "name").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    return d.groupBy("entity_type", "entity").agg(F.min_by("name", F.struct("at", "name")).alias("canonical_name"), F.sort_array(F.collect_set("name")).alias("aliases"), F.sum("n").alias("mentions"))


def dedup_facts(facts: DataFrame, key: list[str], score: str, first: str) -> DataFrame:
    """Of rows with the same key the one with the greatest score (null is least), of equal ones the first."""
    rest = [c for c in facts.columns if c not in key]
    order = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col(first).cast("bigint"))
    return facts.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def last_written(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with the same key the last by the order columns (nulls first); null keys are left out."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")


def gold_facts(facts: DataFrame, examples: DataFrame) -> DataFrame:
    """example_id, fact_id of facts whose sentence is a supporting one. examples: example_id, supporting_facts."""
    e = examples.select("example_id", F.explode("supporting_facts").alias("s")).select("example_id", "s.passage_id", "s.sentence_index").distinct()
    return facts.join(e, ["example_id", "passage_id", "sentence_index"]).select("example_id", "fact_id")


def multihop(examples: DataFrame, passages: DataFrame) -> DataFrame:
    """example_id, titles, passages, explicit (two supporting titles or more), distractor (ten passages and explicit)."""
    s = examples.select("example_id", F.explode("supporting_facts").alias("s")).select("example_id", "s.passage_id").distinct()
    own = passages.groupBy("example_id").agg(F.count(F.lit(1)).alias("passages"))
    titles = s.join(passages.select("passage_id", "title"), "passage_id").groupBy("example_id").agg(F.count_distinct("title").alias("titles"))
    d = examples.select("example_id").join(own, "example_id", "left").join(titles, "example_id", "left")
    d = d.select("example_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("titles", "passages")])
    return d.withColumn("explicit", F.col("titles") >= 2).withColumn("distractor", (F.col("titles") >= 2) & (F.col("passages") == 10))


def verified(links: DataFrame, passages: DataFrame) -> DataFrame:
    """Links (passage_id, sentence_index) with reason: accepted, missing_passage or index_out_of_range. passages: passage_id, sentences."""
    d = links.join(passages.select("passage_id", F.size("sentences").alias("__n")), "passage_id", "left")
    reason = F.when(F.col("__n").isNull(), "missing_passage").when((F.col("sentence_index") < 0) | (F.col("sentence_index") >= F.col("__n")), "index_out_of_range")
    return d.withColumn("reason", reason.otherwise("accepted")).drop("__n")


def evidence_context(facts: DataFrame, limit: int = 12) -> DataFrame:
    """example_id, facts, context: the blocks of the first ``limit`` facts by rank, as a prompt shows them.

    facts: example_id, rank, fact_id, title, section, page, predicate, sentence. A fact without page shows none.
    """
    place = F.concat(F.coalesce("title", F.lit("")), F.lit(", "), F.coalesce("section", F.lit("")), F.coalesce(F.concat(F.lit(", page "), F.col("page").cast("string")), F.lit("")))
    block = F.concat(F.lit("[Evidence "), "fact_id", F.lit("]\nSource: "), place, F.lit("\nFact: "), "predicate", F.lit("\nOriginal text: "), F.coalesce("sentence", F.lit("")))
    d = facts.where(F.col("rank") <= limit).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fact_id", block.alias("b")))).alias("x"))
    return d.select("example_id", F.size("x").alias("facts"), F.array_join("x.b", "\n\n").alias("context"))


def fit_context(documents: DataFrame, group: str, rank: str, text: str, budget: int) -> DataFrame:
    """group, rank, kept, tokens: what of each ranked document fits the running budget; the one that crosses it is cut.

    A text has a token for every four characters begun, one at least. Null texts are left out.
    """
    d = documents.where(F.col(text).isNotNull()).withColumn("__t", F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)))
    w = W.partitionBy(group).orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__left", F.lit(budget) - F.coalesce(F.sum("__t").over(w), F.lit(0))).where(F.col("__left") > 0)
    cut = F.when(F.col("__t") > F.col("__left"), F.expr(f"substring(`{text}`, 1, cast(__left * 4 as int))")).otherwise(F.col(text))
    return d.select(group, rank, cut.alias("kept"), F.least("__t", "__left").alias("tokens"))
