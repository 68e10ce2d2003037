"""Results of other systems: their rankings in the suite's ids, their gaps, their contracts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNMAPPED = "__unmapped__:"


def normalized_ranking(results: DataFrame, passages: DataFrame) -> DataFrame:
    """result_id, rank, candidate: each ranking in passage ids, unmapped entries as ``__unmapped__:entry`` at their places.

    results: result_id, example_id, document_ranking. passages: example_id, passage_id, title. An entry is a
    passage of the example by id or, else, by title (of several, the smallest id); two equi-joins, no OR. Null entries are
    ``__unmapped__:``; an entry that comes again keeps its first place.
    """
    e = results.select("result_id", "example_id", F.posexplode("document_ranking").alias("pos", "entry")).withColumn("entry", F.coalesce("entry", F.lit("")))
    by_id = passages.select("example_id", F.col("passage_id").alias("entry"), F.col("passage_id").alias("__i")).distinct()
    by_title = passages.where(F.col("title").isNotNull()).groupBy("example_id", F.col("title").alias("entry")).agg(F.min("passage_id").alias("__t"))
    d = e.join(by_id, ["example_id", "entry"], "left").join(by_title, ["example_id", "entry"], "left")
    unmapped = F.when(F.col("entry").startswith(UNMAPPED), F.col("entry")).otherwise(F.concat(F.lit(UNMAPPED), "entry"))
    d = d.groupBy("result_id", F.coalesce("__i", "__t", unmapped).alias("candidate")).agg(F.min("pos").alias("pos"))
    each = d.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate"))).alias("x"))
    return each.select("result_id", F.posexplode("x.candidate").alias("rank", "candidate")).withColumn("rank", F.col("rank") + 1)


def coverage(rankings: DataFrame) -> DataFrame:
    """result_id, entries, mapped, coverage of normalized rankings."""
    known = (~F.col("candidate").startswith(UNMAPPED)).cast("int")
    return rankings.groupBy("result_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(known).alias("mapped"), F.round(F.avg(known), 6).alias("coverage"))


def audit(results: DataFrame, examples: DataFrame) -> DataFrame:
    """Per system: expected, received, missing, duplicates, unknown, succeeded, failed, unscorable examples.

    results: system, example_id, status. examples: example_id (unique). An example succeeded if one of its results did, else it is
    unscorable if one of them is.
    """
    known = examples.select("example_id", F.lit(True).alias("__known"))
    d = results.join(known, "example_id", "left").groupBy("system", "example_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("__known").alias("known"),
        F.max((F.col("status") == "success").cast("int")).alias("ok"), F.max((F.col("status") == "unscorable").cast("int")).alias("un"),
    )
    g = F.col("known").isNotNull()
    ok, un = F.coalesce("ok", F.lit(0)) == 1, F.coalesce("un", F.lit(0)) == 1
    d = d.groupBy("system").agg(
        F.count_if(g).alias("received"), F.count_if(g & (F.col("n") > 1)).alias("duplicates"), F.count_if(~g).alias("unknown"),
        F.count_if(g & ok).alias("succeeded"), F.count_if(g & ~ok & ~un).alias("failed"), F.count_if(g & ~ok & un).alias("unscorable"),
    )
    expected = F.lit(examples.count())
    return d.withColumn("expected", expected).withColumn("missing", expected - F.col("received"))


def contract(results: DataFrame, column: str, want: str) -> DataFrame:
    """Per system: rows, with the wanted value of a column, and whether all rows have it (null is another value)."""
    same = F.coalesce(F.col(column) == want, F.lit(False))
    return results.groupBy("system").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("same"), F.bool_and(same).alias("holds"))


def unfinished(results: DataFrame, examples: DataFrame, systems: int) -> DataFrame:
    """example_id of the examples that are still to be run: not all ``systems`` have succeeded on them."""
    done = results.where(F.col("status") == "success").groupBy("example_id").agg(F.count_distinct("system").alias("n")).where(F.col("n") == systems)
    return examples.select("example_id").join(done, "example_id", "left_anti")


def one_to_one(old: DataFrame, new: DataFrame, key: str, same: list[str]) -> DataFrame:
    """old_id, new_id of rows whose ``same`` columns agree with exactly one row on the other side (nulls agree)."""
    hashed = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)
    once = lambda d, name: d.select(key, hashed.alias("h")).groupBy("h").agg(F.min(key).alias(name), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).drop("n")
    return once(old, "old_id").join(once(new, "new_id"), "h").select("old_id", "new_id")


def packed(rows: DataFrame, group: str, order: list[str], size: str, most: int) -> DataFrame:
    """Adds ``batch`` (from 0 within the group): rows in order, a new batch where ``size`` would exceed ``most``.

    Groups stream through their task one row at a time; a row larger than ``most`` is a batch of its own. Null sizes count as 0.
    """
    schema = rows.withColumn("batch", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, no, used, held = object(), 0, 0, False
        for b in batches:
            out = []
            for g, n in zip(b.column(group).to_pylist(), b.column(size).to_pylist()):
                n = n or 0
                if g != who:
                    who, no, used, held = g, 0, 0, False
                if held and used + n > most:
                    no, used = no + 1, 0
                used, held = used + n, True
                out.append(no)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def declared(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``ranking`` (array of VARIANT) and ``declared``: the first of the fields that a record (raw VARIANT) has, even if it is null or empty.

    A value that is no list is a list of one.
    """
    keys = F.map_keys(F.expr("try_cast(raw AS map<string, variant>)"))
    d = raw.withColumn("__f", F.try_element_at(F.filter(F.array(*map(F.lit, fields)), lambda f: F.array_contains(keys, f)), F.lit(1)))
    picked = [F.when(F.col("__f") == f, F.coalesce(F.expr(f"try_variant_get(raw, '$.{f}', 'array<variant>')"), F.when(F.expr(f"try_variant_get(raw, '$.{f}', 'string')").isNotNull(), F.array(F.expr(f"variant_get(raw, '$.{f}', 'variant')"))))) for f in fields]
    return d.withColumn("ranking", F.coalesce(*picked, F.array().cast("array<variant>"))).withColumn("declared", F.col("__f").isNotNull()).drop("__f")


# The names under which a candidate refers to a passage itself, and to several others.
DIRECT = ("passage_id", "document_id", "id", "title", "index")
NESTED = ("source_passage_ids", "source_document_ids", "source_titles", "source_indices", "source_ids", "sources", "passages", "documents", "chunks", "text_units")


def references(value: object, depth: int = 0) -> list[tuple[str | None, int | None]]:
    """(text, index) of what a candidate (a parsed JSON value) refers to, itself or through what it holds."""
    if isinstance(value, bool) or value is None:
        return [(str(value), None)]
    if isinstance(value, int):
        return [(str(value), value)]
    if not isinstance(value, dict):
        return [(str(value), None)]
    own = [(str(value[k]), value[k] if isinstance(value[k], int) else None) for k in DIRECT if value.get(k) is not None]
    if own or depth > 20:
        return own
    inner = [x for k in NESTED if k in value for x in (value[k] if isinstance(value[k], list) else [value[k]])]
    return [r for x in inner for r in references(x, depth + 1)]


def mapped_candidates(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """result_id, rank, candidate of rows (result_id, example_id, ranking as array of VARIANT): as normalized_ranking, for candidates of any form.

    A candidate is a text or number, or an object that names passages by id, title or index (from 0 in the example), or holds
    such objects. passages: example_id, passage_id, title, pos. A candidate that maps to nothing is ``__unmapped__:label``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, e, pos, text in zip(*(c.to_pylist() for c in b.columns)):
                v = json.loads(text) if text is not None else None
                label = next((str(v[k]) for k in ("id", "community_id", "entity_id", "title", "passage_id") if k in v), str(v)) if isinstance(v, dict) else "" if v is None else str(v)
                out += [(row, e, pos, i, label, t, n) for i, (t, n) in enumerate(references(v) or [(None, None)])]
            kinds = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["result_id", "example_id", "pos", "sub", "label", "text", "index"])

    kind = dict(rows.dtypes)["result_id"]
    e = rows.select("result_id", "example_id", F.posexplode("ranking").alias("pos", "v")).select("result_id", "example_id", "pos", F.to_json("v").alias("v"))
    e = e.mapInArrow(read, f"result_id {kind}, example_id string, pos int, sub int, label string, text string, index bigint")
    by_id = passages.select("example_id", F.col("passage_id").alias("text"), F.col("passage_id").alias("__i")).distinct()
    by_title = passages.where(F.col("title").isNotNull()).groupBy("example_id", F.col("title").alias("text")).agg(F.min("passage_id").alias("__t"))
    by_index = passages.select("example_id", F.col("pos").cast("bigint").alias("index"), F.col("passage_id").alias("__n"))
    d = e.join(by_id, ["example_id", "text"], "left").join(by_title, ["example_id", "text"], "left").join(by_index, ["example_id", "index"], "left")
    d = d.withColumn("found", F.coalesce("__n", "__i", "__t"))
    some = d.groupBy("result_id", "pos").agg(F.count("found").alias("n"))
    d = d.join(some, ["result_id", "pos"])
    lost = F.when(F.col("n") == 0, F.concat(F.lit(UNMAPPED), F.regexp_replace("label", f"^{UNMAPPED}", "")))
    d = d.withColumn("candidate", F.coalesce("found", lost)).where(F.col("candidate").isNotNull())
    d = d.groupBy("result_id", "candidate").agg(F.min(F.struct("pos", "sub")).alias("at"))
    each = d.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("at", "candidate"))).alias("x"))
    return each.select("result_id", F.posexplode("x.candidate").alias("rank", "candidate")).withColumn("rank", F.col("rank") + 1)


def units_of(rankings: DataFrame, units: DataFrame, unknown: str | None = None) -> DataFrame:
    """result_id, rank, unit: the units (fact_id, unit) that ranked facts (result_id, fact_id, rank) stand for, in first-seen order.

    A fact without a unit is left out, or kept at its place as ``unknown`` and its id.
    """
    d = rankings.join(units, "fact_id", "left" if unknown is not None else "inner")
    d = d.withColumn("unit", F.coalesce("unit", F.concat(F.lit(unknown or ""), "fact_id"))).groupBy("result_id", "unit").agg(F.min("rank").alias("first"))
    each = d.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("first", "unit"))).alias("x"))
    return each.select("result_id", F.posexplode("x.unit").alias("rank", "unit")).withColumn("rank", F.col("rank") + 1)


def marked_ranking(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """result_id, document_id, rank: the documents that a text names, by where it first does; ties go to the smaller id.

    texts: result_id, example_id, text. documents: example_id, document_id, marker. A null or empty marker names nothing.
    """
    d = texts.join(documents.where(F.col("marker") != ""), "example_id").withColumn("at", F.expr("instr(text, marker)")).where(F.col("at") > 0)
    d = d.groupBy("result_id", "document_id").agg(F.min("at").alias("at"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("result_id").orderBy("at", "document_id"))).drop("at")


def expected_results(results: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """A row per system and example: the result with the smallest key, or status ``missing`` and nulls.

    The systems are read first; each example is repeated for every one of them.
    """
    names = [r.system for r in results.select("system").where(F.col("system").isNotNull()).distinct().collect()]  # a row per system
    each = examples.select("example_id", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("system"))
    rest = [c for c in results.columns if c not in ("system", "example_id")]
    first = results.groupBy("system", "example_id").agg(F.min_by(F.struct(*rest), key).alias("r")).select("system", "example_id", "r.*")
    return each.join(first, ["system", "example_id"], "left").withColumn("status", F.when(F.col(key).isNull(), "missing").otherwise(F.col("status")))
