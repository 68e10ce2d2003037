"""Data sets' raw records (raw VARIANT) as examples of one form.

Each gives example_id, question, answer, passages (passage_id, title, sentences), supporting_facts (passage_id,
sentence_index), bridge_entities, gold_path, hop_count, query_type, dataset, metadata (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import safe_id, split_sentences


def _get(path: str, kind: str = "string", of: str = "raw") -> Column:
    return F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")


def _first(*paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[_get(p, kind) for p in paths])


def _strings(path: str) -> Column:
    """A text or a list of texts as a list; empty where it is missing."""
    return F.coalesce(_get(path, "array<string>"), F.when(_get(path).isNotNull(), F.array(_get(path))), F.array().cast("array<string>"))


def answers(d: DataFrame) -> Column:
    """The answer and its aliases, each once."""
    return F.array_distinct(F.concat(_strings("answer"), _strings("answer_aliases")))


def _passages(contexts: Column) -> Column:
    """Structs of passage_id (example and number), title and sentences."""
    return F.transform(contexts, lambda c, i: F.struct(F.concat(safe_id(F.col("example_id")), F.lit("_p"), i.cast("string")).alias("passage_id"), c["title"].alias("title"), c["sentences"].alias("sentences")))


def _pairs(path: str, name: str, other: str, kind: str) -> Column:
    """Structs of a title and ``name`` from a list of two-element lists, or from an object of two lists."""
    rows = F.transform(_get(path, "array<variant>"), lambda v: F.struct(F.try_variant_get(v, "$[0]", "string").alias("title"), F.try_variant_get(v, "$[1]", kind).alias(name)))
    zipped = F.arrays_zip(_get(f"{path}.title", "array<string>").alias("title"), _get(f"{path}.{other}", f"array<{kind}>").alias(name))
    columns = F.transform(zipped, lambda z: F.struct(z["title"].alias("title"), z[name].alias(name)))
    return F.coalesce(rows, columns, F.array().cast(f"array<struct<title:string,{name}:{kind}>>"))


def _hotpot(raw: DataFrame) -> DataFrame:
    """example_id, question, contexts, supports (title, sentence_index) of records in this form."""
    d = raw.select("raw", F.coalesce(_first("_id", "id"), F.lit("unknown")).alias("example_id"), _get("question").alias("question"))
    return d.withColumn("contexts", _pairs("context", "sentences", "sentences", "array<string>")).withColumn("supports", _pairs("supporting_facts", "sentence_index", "sent_id", "int"))


def _hotpot_examples(d: DataFrame, dataset: str, answer: Column, metadata: Column) -> DataFrame:
    d = d.withColumn("passages", _passages(F.col("contexts")))
    # of passages with the same title the last counts
    named = F.transform("supports", lambda s: F.struct(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("passages", lambda p: p["title"] == s["title"]), lambda p: p["passage_id"])), -1).alias("passage_id"), s["sentence_index"].alias("sentence_index")))
    d = d.withColumn("supporting_facts", F.filter(named, lambda s: s["passage_id"].isNotNull()))
    d = d.withColumn("supporting_facts", F.when(F.size("supporting_facts") > 0, F.col("supporting_facts")).otherwise(F.raise_error(F.concat(F.lit("no valid supporting facts: "), "example_id"))))
    held = F.filter("passages", lambda p: F.exists("supporting_facts", lambda s: s["passage_id"] == p["passage_id"]))
    d = d.withColumn("titles", F.transform(held, lambda p: p["title"])).withColumn("gold_path", F.transform(held, lambda p: p["passage_id"]))
    n, kind = F.size("titles"), F.coalesce(_first("type", "question_type"), F.lit("unknown"))
    bridges = F.when(_get("type") == "bridge", F.slice("titles", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.slice("titles", F.lit(2), F.greatest(n - 2, F.lit(0))))
    return d.select(
        "example_id", "question", answer.alias("answer"), "passages", "supporting_facts", bridges.alias("bridge_entities"), "gold_path",
        F.greatest(F.lit(2), F.size(F.array_distinct("titles"))).alias("hop_count"), kind.alias("query_type"), F.lit(dataset).alias("dataset"), metadata.alias("metadata"),
    )


def hotpot(raw: DataFrame) -> DataFrame:
    """Context and supports as lists of pairs or as columns. A record without a support in its context is an error."""
    config = F.when(F.size("contexts") == 10, "distractor").otherwise("unspecified")
    meta = F.to_json(F.struct(_get("level").alias("level"), config.alias("benchmark_config"), F.lit("sentence").alias("evidence_level")))
    return _hotpot_examples(_hotpot(raw), "hotpotqa", _strings("answer"), meta)


def two_wiki(raw: DataFrame) -> DataFrame:
    """As hotpot, with aliases; a support beyond its passage becomes the sentence that names most entities of the title's evidences.

    Of equally good sentences the last counts; if none names any, that is an error.
    """
    d = _hotpot(raw).withColumn("triples", F.coalesce(_get("evidences", "array<array<string>>"), _get("evidence", "array<array<string>>"), F.array().cast("array<array<string>>")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0))

    def same(a: Column, b: Column) -> Column:
        x, y = words(a), words(b)
        return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= 0.75 * F.least(F.size(x), F.size(y)))

    def repaired(s: Column) -> Column:
        own = F.element_at(F.concat(F.array(F.array().cast("array<string>")), F.transform(F.filter("contexts", lambda c: c["title"] == s["title"]), lambda c: c["sentences"])), -1)
        part = lambda t, k: F.trim(F.coalesce(F.get(t, F.lit(k)), F.lit("")))
        other = F.filter(F.transform("triples", lambda t: F.when(same(part(t, 0), s["title"]) & (part(t, 2) != ""), part(t, 2)).when(same(part(t, 2), s["title"]) & (part(t, 0) != ""), part(t, 0))), lambda e: e.isNotNull())
        scored = F.transform(own, lambda x, i: F.struct(F.size(F.filter(other, lambda e: F.contains(F.lower(x), F.lower(e)))).alias("n"), i.alias("i")))
        best = F.array_max(scored)
        fits = (s["sentence_index"] >= 0) & (s["sentence_index"] < F.size(own))
        found = F.when(fits, s["sentence_index"]).when(best["n"] > 0, best["i"]).otherwise(F.raise_error(F.concat(F.lit("support out of range: "), "example_id")).cast("int"))
        return F.struct(s["title"].alias("title"), found.cast("int").alias("sentence_index"))

    d = d.withColumn("given", F.col("supports")).withColumn("supports", F.transform("supports", repaired))
    changed = F.size(F.filter(F.zip_with("given", "supports", lambda a, b: a["sentence_index"] != b["sentence_index"]), lambda x: x))
    meta = F.to_json(F.struct(_get("level").alias("level"), F.lit("dev").alias("benchmark_config"), changed.alias("repairs"), F.col("triples").alias("evidences")))
    return _hotpot_examples(d, "2wikimultihopqa", answers(d), meta)


def musique(raw: DataFrame) -> DataFrame:
    """All sentences of supporting paragraphs are supports; the path is the decomposition's questions."""
    d = raw.select("raw", F.coalesce(_first("id", "question_id"), F.lit("unknown")).alias("example_id"), _get("question").alias("question"))
    each = F.coalesce(_first("paragraphs", "context", kind="array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")

    def paragraph(v: Column, i: Column) -> Column:
        own = F.try_variant_get(v, "$.sentences", "array<string>")
        cut = split_sentences(F.coalesce(text(v, "paragraph_text"), text(v, "text"), F.lit("")))
        return F.struct(F.coalesce(text(v, "title"), F.concat(F.lit("Paragraph "), i.cast("string"))).alias("title"), F.when(F.size(own) > 0, own).otherwise(cut).alias("sentences"), F.coalesce(text(v, "is_supporting"), text(v, "supporting"), F.lit("false")).alias("s"))

    d = d.withColumn("contexts", F.transform(each, paragraph)).withColumn("passages", _passages(F.col("contexts")))
    marked = F.zip_with("passages", "contexts", lambda p, c: F.when((c["s"] == "true") & (F.size(p["sentences"]) > 0), F.transform(F.sequence(F.lit(0), F.size(p["sentences"]) - 1), lambda k: F.struct(p["passage_id"].alias("passage_id"), k.alias("sentence_index")))))
    steps = F.coalesce(_first("question_decomposition", "decomposition", kind="array<variant>"), F.array().cast("array<variant>"))
    d = d.withColumn("supporting_facts", F.flatten(F.filter(marked, lambda m: m.isNotNull()))).withColumn("steps", steps)
    n = F.greatest(F.lit(1), F.size("steps"))
    bridges = F.filter(F.transform(F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))), lambda v: text(v, "answer")), lambda a: a != "")
    return d.select(
        "example_id", "question", answers(d).alias("answer"), "passages", "supporting_facts", bridges.alias("bridge_entities"), F.transform("steps", lambda v: F.coalesce(text(v, "question"), v.cast("string"))).alias("gold_path"),
        n.alias("hop_count"), F.concat(n.cast("string"), F.lit("-hop")).alias("query_type"), F.lit("musique").alias("dataset"), F.to_json(F.struct(F.lit("paragraph").alias("evidence_level"))).alias("metadata"),
    )


def ultra_domain(raw: DataFrame) -> DataFrame:
    """A context of one text or of several passages, no supports. A record without a question is an error."""
    d = raw.select("raw", F.coalesce(_first("_id", "id", "example_id"), F.lit("unknown")).alias("example_id"), F.trim(F.coalesce(_first("question", "input"), F.lit(""))).alias("question"))
    d = d.withColumn("question", F.when(F.col("question") != "", F.col("question")).otherwise(F.raise_error(F.concat(F.lit("no question: "), "example_id"))))
    domain = F.coalesce(_first("domain", "category", "dataset"), F.lit("general"))
    text = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")

    def item(v: Column, i: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        titled = F.coalesce(text(v, "title"), F.concat(F.lit("Domain_"), domain, F.lit("_"), i.cast("string")))
        own = F.try_variant_get(v, "$.sentences", "array<string>")
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        return F.struct(F.when(is_object, titled).otherwise(F.concat(F.lit("Passage_"), i.cast("string"))).alias("title"), F.when(is_object, F.when(F.size(own) > 0, own).otherwise(split_sentences(F.coalesce(text(v, "text"), F.lit(""))))).otherwise(split_sentences(plain)).alias("sentences"))

    many = F.transform(_first("context", "paragraphs", kind="array<variant>"), item)
    one = F.array(F.struct(F.concat(F.lit("Domain_"), domain).alias("title"), split_sentences(F.coalesce(_get("context"), F.lit(""))).alias("sentences")))
    d = d.withColumn("passages", _passages(F.coalesce(many, one)))
    answer = F.when(_get("answer", "variant").isNotNull(), _strings("answer")).otherwise(_strings("answers"))
    none = F.array().cast("array<struct<passage_id:string,sentence_index:int>>")
    length = F.aggregate("passages", F.lit(0), lambda n, p: n + F.length(F.array_join(p["sentences"], " ")))
    return d.select(
        "example_id", "question", answer.alias("answer"), "passages", none.alias("supporting_facts"), F.array().cast("array<string>").alias("bridge_entities"), F.array().cast("array<string>").alias("gold_path"),
        F.lit(1).alias("hop_count"), F.concat(F.lit("domain_"), domain).alias("query_type"), F.lit("ultradomain").alias("dataset"), F.to_json(F.struct(domain.alias("domain"), length.alias("context_length"))).alias("metadata"),
    )


ADAPTERS = {"hotpotqa": hotpot, "2wiki": two_wiki, "2wikimultihopqa": two_wiki, "musique": musique, "ultradomain": ultra_domain}


def mix(raw: DataFrame) -> DataFrame:
    """Records of several data sets, each by the adapter its ``dataset`` names; another name is an error."""
    name = F.lower(F.coalesce(_get("dataset"), F.lit("")))
    known = raw.withColumn("raw", F.when(name.isin(*ADAPTERS), F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("unsupported data set: "), name))))
    out = None
    for key, adapter in ADAPTERS.items():
        d = adapter(known.where(name == key)).withColumn("dataset", F.lit("mix")).withColumn("original_dataset", F.lit(key))
        out = d if out is None else out.unionByName(d)
    return out
