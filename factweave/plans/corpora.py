"""Corpora: facts of sentences, samples, merges, contexts and caches, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave import api
from factweave.functions import text
from factweave.operators import corpus, external, facts, ranking
from factweave.plans.common import EXAMPLES, PASSAGES, examples, once, passages
from factweave.sinks import report
from factweave.sources.tables import table


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts.sentence_facts(passages(spark, folder))


def sentence_facts(spark: SparkSession, folder: str) -> DataFrame:
    d = _facts(spark, folder)
    arguments = F.array_join(F.transform("arguments", lambda a: F.concat(a["role"], F.lit("="), a["entity_id"])), "|")
    return d.select("fact_id", "chunk_id", "passage_id", "sentence_index", "start_char", arguments.alias("arguments"))


def fact_verbalize(spark: SparkSession, folder: str) -> DataFrame:
    d = _facts(spark, folder)
    return d.select("fact_id", facts.verbalized(F.lit("states"), F.col("arguments"), F.create_map(F.lit("example_id"), F.col("example_id"))).alias("verbalized"))


def fact_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the facts with their names and facts; a name is the first by fact_id."""
    d = _facts(spark, folder).select("fact_id", F.explode("arguments").alias("a")).select("fact_id", "a.*")
    return d.groupBy("entity_id").agg(F.min_by("name", F.struct("fact_id", "name")).alias("name"), F.count_distinct("fact_id").alias("facts"))


def fact_args_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that keep two arguments or more where only entities of two facts or more are known."""
    d = _facts(spark, folder)
    known = d.select("fact_id", F.explode("arguments.entity_id").alias("entity_id")).groupBy("entity_id").agg(F.count_distinct("fact_id").alias("n")).where("n > 1")
    v = facts.valid_arguments(d, known)
    return v.select("fact_id", F.size("arguments").alias("kept"))


def gold_facts(spark: SparkSession, folder: str) -> DataFrame:
    return facts.gold_facts(_facts(spark, folder), examples(spark, folder))


def multihop_filter(spark: SparkSession, folder: str) -> DataFrame:
    return facts.multihop(examples(spark, folder), passages(spark, folder))


def context_build(spark: SparkSession, folder: str) -> DataFrame:
    """The context of an example's supporting sentences in the order they are given."""
    e = examples(spark, folder).select("example_id", F.posexplode("supporting_facts").alias("pos", "s")).select("example_id", (F.col("pos") + 1).alias("rank"), "s.passage_id", "s.sentence_index")
    d = e.join(_facts(spark, folder).drop("example_id"), ["passage_id", "sentence_index"])
    d = d.select("example_id", "rank", "fact_id", "title", F.col("title").alias("section"), F.lit(None).cast("int").alias("page"), F.lit("states").alias("predicate"), "sentence")
    return facts.evidence_context(d)


def context_fit(spark: SparkSession, folder: str) -> DataFrame:
    p = passages(spark, folder).select("example_id", "passage_id", F.concat_ws("\n", "title", F.array_join("sentences", " ")).alias("body")).where(F.col("example_id").isNotNull())
    d = facts.fit_context(p, "example_id", "passage_id", "body", 200)
    return d.select("example_id", "passage_id", F.length("kept").alias("kept"), "tokens")


def batch_packing(spark: SparkSession, folder: str) -> DataFrame:
    d = _facts(spark, folder).select("passage_id", "sentence_index", F.length("sentence").alias("size"))
    return external.packed(d, "passage_id", ["sentence_index"], "size", 400)


def suite_merge(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("document_id", "version", "ingested_at", "doc_id", "title")
    return facts.last_written(d, "document_id", ["version", "ingested_at", "doc_id"])


def reuse_audit(spark: SparkSession, folder: str) -> DataFrame:
    """First versions of documents and later ones with the same title, one to one."""
    d = table(spark, folder, "documents").select("doc_id", "title", "version")
    return external.one_to_one(d.where("version = 1"), d.where("version > 1"), "doc_id", ["title"])


def fact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "scored_facts").dropna(subset=["query_id", "fact_id", "rank"]).where(~F.isnan(F.coalesce("score", F.lit(0.0))))
    return facts.dedup_facts(d.select("query_id", "fact_id", "score", "rank"), ["query_id", "fact_id"], "score", "rank").select("query_id", "fact_id", "score")


def fixed_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 examples with the smallest hash of seed and id."""
    e = table(spark, folder, "benchmark_examples").select("example_id").where(F.col("example_id").isNotNull()).distinct()
    return e.withColumn("h", F.sha2(F.concat(F.lit("42:"), "example_id"), 256)).orderBy("h").limit(100)


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """120 documents, as many of each domain; the first domains by hash get one more. A domain with fewer gives all it has."""
    d = table(spark, folder, "documents").select("doc_id", text.category_key(F.col("domain")).alias("domain")).where(F.col("domain").isNotNull())
    names = d.select("domain").distinct()
    n = names.count()
    place = F.row_number().over(W.orderBy(F.sha2(F.concat(F.lit("42:"), "domain"), 256)))  # a row per domain
    quota = names.withColumn("quota", F.lit(120 // max(n, 1)) + (place <= 120 % max(n, 1)).cast("int"))
    d = ranking.top(d.withColumn("h", F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256)), ["domain"], [F.col("h")], 121, "place")
    return d.join(quota, "domain").where(F.col("place") <= F.col("quota")).select("domain", "doc_id")


def request_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Per request: its digest, whether it is JSON, and the tokens to set aside (characters / 4 rounded up, and its max_tokens)."""
    d = once(table(spark, folder, "llm_responses"), "cache_key")
    most = F.coalesce(F.get_json_object("request", "$.max_tokens").try_cast("bigint"), F.lit(0))
    return d.select("cache_key", (F.floor((F.length("request") + 3) / 4) + most).alias("tokens"), text.json_digest("request").alias("digest"))


def repaired_answers(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "llm_responses"), "cache_key").select("cache_key", text.repaired_json("response").alias("json"))


def chunk_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of sections with the approximate place of their first and last token in the section's text."""
    s = once(table(spark, folder, "sections"), "section_id")
    return corpus.placed_windows(s, "section_id", "text", 32, 8)


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = corpus.windows(once(table(spark, folder, "sections"), "section_id"), "section_id", "text", 32, 8)
    return d.select("section_id", "chunk_no", text.short_id("chunk", F.concat_ws(":", "section_id", "chunk_no")).alias("chunk_id"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


def derived_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """A seed for every data set, and how many examples it has."""
    d = examples(spark, folder).groupBy(text.category_key(F.col("dataset")).alias("dataset")).agg(F.count(F.lit(1)).alias("examples")).where(F.col("dataset").isNotNull())
    return d.select("dataset", "examples", text.derived_seed(F.concat(F.lit("42:"), "dataset")).alias("seed"))


def export_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = _facts(spark, folder)
    return d.select("passage_id", "sentence_index", text.export_id(F.col("passage_id"), F.col("sentence_index")).alias("fact_id"))


def record_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every result among its example's, by system and time."""
    r = once(table(spark, folder, "baseline_results"), "result_id")
    w = W.partitionBy("example_id").orderBy("system", "finished_at", "result_id")
    return r.select("example_id", "result_id", F.row_number().over(w).alias("place"))


def retrieved_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """From a question to its context: facts of sentences, BM25 over them, the 12 best as a prompt shows them."""
    index = api.build_index(api.Corpus.of(passages(spark, folder)))
    q = table(spark, folder, "eval_items").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return api.contexts(index, api.retrieve(index, q))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.canonical_rows(examples(spark, folder), _facts(spark, folder), passages(spark, folder).where(F.col("example_id").isNotNull()), "suite", 42)


def suite_rows(spark: SparkSession, folder: str) -> DataFrame:
    d = _rows(spark, folder)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return d.select("example_id", "answer", n("documents").alias("documents"), n("facts").alias("facts"), F.coalesce(F.array_join("gold_fact_ids", "|"), F.lit("")).alias("gold"))


def suite_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples read back from the suite's rows."""
    d = report.examples_of(_rows(spark, folder))
    return d.select("example_id", F.size("passages").alias("passages"), F.size("supporting_facts").alias("supports"), F.aggregate("passages", F.lit(0), lambda n, p: n + F.size(p["sentences"])).alias("sentences"))


def dataset_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an example is taken up: hotpotqa with ten passages and two supporting titles, musique with two steps, others with two titles."""
    d = multihop_filter(spark, folder).join(examples(spark, folder).select("example_id", "hop_count", F.replace(text.category_key(F.col("dataset")), F.lit("_"), F.lit("")).alias("name")), "example_id")
    taken = F.when(F.col("name") == "hotpotqa", F.col("distractor")).when(F.col("name") == "musique", F.coalesce(F.col("hop_count") >= 2, F.lit(False))).otherwise(F.col("explicit"))
    return d.select("example_id", "name", taken.alias("taken"))


QUERIES = {f.__name__: f for f in (
    suite_rows, suite_examples, dataset_filter, derived_seeds, export_ids, record_order, retrieved_contexts, sentence_facts, fact_verbalize, fact_entities, fact_args_valid, gold_facts, multihop_filter, context_build, context_fit, batch_packing, suite_merge, reuse_audit, fact_dedup,
    fixed_sample, stratified_sample, request_costs, repaired_answers, chunk_offsets, chunk_ids)}

_KEY = r"nullif(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g'), '')"
_FACTS = f"""
s AS (SELECT coalesce(example_id, '') AS example_id, passage_id, coalesce(title, '') AS title, [coalesce(x, '') FOR x IN sentences] AS ss FROM ({PASSAGES})),
x AS (SELECT *, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS i FROM s),
c AS (SELECT *, 'chunk_' || substr(sha1(example_id || ':' || passage_id || ':' || i), 1, 16) AS chunk_id, coalesce(list_sum([length(y) + 1 FOR y IN ss[1:i]]), 0)::INT AS start_char,
  list_filter([trim(y) FOR y IN list_concat([title], regexp_extract_all(sentence, '{text.NAMES.replace("'", "''")}', 1), regexp_extract_all(sentence, '{text.LONG_WORDS.replace("'", "''")}', 1))], lambda y: y <> '') AS each FROM x),
d AS (SELECT *, [lower(y) FOR y IN each] AS low FROM c),
n AS (SELECT *, list_filter(each, lambda y, k: list_position(low, lower(y)) = k)[1:8] AS names FROM d),
m AS (SELECT *, 'fact_' || substr(sha1(chunk_id), 1, 16) AS fact_id, list_concat([{{'role': 'source', 'id': 'ent_' || substr(sha1('title:' || lower(title)), 1, 16), 'name': title}}],
  [{{'role': 'mention', 'id': 'ent_' || substr(sha1('concept:' || lower(y)), 1, 16), 'name': y}} FOR y IN names]) AS base FROM n),
f AS (SELECT *, CASE WHEN len(list_distinct([y.id FOR y IN base])) < 2 THEN list_concat(base, [{{'role': 'statement', 'id': 'ent_' || substr(sha1('sentence:' || chunk_id), 1, 16), 'name': 'sentence ' || i}}]) ELSE base END AS args FROM m)"""
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_SECTIONS = "SELECT DISTINCT ON (section_id) * FROM sections WHERE section_id IS NOT NULL"
_WINDOWS = f"""
t AS (SELECT section_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM ({_SECTIONS})),
w AS (SELECT section_id, t, unnest(range(0, greatest(0, ceil((len(t) - 32) / 24.0))::BIGINT + 1)) AS k FROM t WHERE len(t) > 0)"""

_TERMS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"

_GOLD_FACTS = f"""
{_FACTS}, nb AS (SELECT * FROM f WHERE regexp_matches(sentence, '\\S')), gx AS (SELECT example_id, unnest(supporting_facts) AS s, generate_subscripts(supporting_facts, 1) AS pos FROM ({EXAMPLES})),
gf AS (SELECT gx.example_id, nb.fact_id, min(pos) AS pos FROM gx JOIN nb ON nb.example_id = gx.example_id AND nb.passage_id = gx.s.passage_id AND nb.i = gx.s.sentence_index GROUP BY ALL),
gg AS (SELECT example_id, string_agg(fact_id, '|' ORDER BY pos) AS gold, count(*)::INT AS supports FROM gf GROUP BY ALL), fc AS (SELECT example_id, count(*)::INT AS facts FROM nb GROUP BY ALL),
dc AS (SELECT example_id, count(*)::INT AS documents FROM ({PASSAGES}) WHERE example_id IS NOT NULL GROUP BY ALL)"""

SQL = {
    "suite_rows": f"WITH {_GOLD_FACTS} SELECT example_id, answer[1] AS answer, coalesce(documents, 0) AS documents, coalesce(facts, 0) AS facts, coalesce(gold, '') AS gold FROM ({EXAMPLES}) LEFT JOIN dc USING (example_id) LEFT JOIN fc USING (example_id) LEFT JOIN gg USING (example_id)",
    "suite_examples": f"WITH {_GOLD_FACTS} SELECT example_id, coalesce(documents, 0) AS passages, coalesce(supports, 0) AS supports, coalesce(facts, 0) AS sentences FROM ({EXAMPLES}) LEFT JOIN dc USING (example_id) LEFT JOIN fc USING (example_id) LEFT JOIN gg USING (example_id)",
    "dataset_filter": f"""
WITH e AS ({EXAMPLES}), p AS ({PASSAGES}), s AS (SELECT DISTINCT example_id, s.passage_id AS passage_id FROM (SELECT example_id, unnest(supporting_facts) AS s FROM e)),
t AS (SELECT s.example_id, count(DISTINCT title) AS titles FROM s JOIN p USING (passage_id) GROUP BY ALL), n AS (SELECT example_id, count(*) AS passages FROM p GROUP BY ALL),
m AS (SELECT example_id, hop_count, replace({_KEY.format("dataset")}, '_', '') AS name, coalesce(titles, 0) >= 2 AS explicit, coalesce(passages, 0) = 10 AS ten FROM e LEFT JOIN t USING (example_id) LEFT JOIN n USING (example_id))
SELECT example_id, name, CASE WHEN name = 'hotpotqa' THEN explicit AND ten WHEN name = 'musique' THEN coalesce(hop_count >= 2, false) ELSE explicit END AS taken FROM m""",
    "derived_seeds": f"WITH g AS (SELECT {_KEY.format('dataset')} AS dataset, count(*) AS examples FROM ({EXAMPLES}) GROUP BY ALL) SELECT dataset, examples, ('0x' || substr(sha256('42:' || dataset), 1, 16))::UBIGINT::VARCHAR AS seed FROM g WHERE dataset IS NOT NULL",
    "export_ids": f"WITH {_FACTS} SELECT passage_id, i::INT AS sentence_index, 'fact_' || substr(sha256(passage_id || ':' || i), 1, 16) AS fact_id FROM f",
    "record_order": "SELECT example_id, result_id, (row_number() OVER (PARTITION BY example_id ORDER BY system NULLS FIRST, finished_at NULLS FIRST, result_id))::INT AS place FROM (SELECT DISTINCT ON (result_id) * FROM baseline_results WHERE result_id IS NOT NULL)",
    "retrieved_contexts": f"""
WITH {_FACTS}, dt AS (SELECT fact_id, {_TERMS.format("concat_ws(' ', title, sentence)")} AS t FROM f), nn AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format("question")}) AS term FROM eval_items WHERE item_id % 20 = 0),
po AS (SELECT fact_id, len(t) AS dl, unnest(t) AS term FROM dt), tf AS (SELECT fact_id, dl, term, count(*) AS tf FROM po WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, fact_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), nn GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM sc),
b AS (SELECT query_id, rank, '[Evidence ' || fact_id || ']' || chr(10) || 'Source: ' || title || ', ' || title || chr(10) || 'Fact: states' || chr(10) || 'Original text: ' || sentence AS b FROM rk JOIN f USING (fact_id) WHERE rank <= 12)
SELECT query_id, count(*)::INT AS facts, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY ALL""",
    "sentence_facts": f"WITH {_FACTS} SELECT fact_id, chunk_id, passage_id, i::INT AS sentence_index, start_char, array_to_string([a.role || '=' || a.id FOR a IN args], '|') AS arguments FROM f",
    "fact_verbalize": f"WITH {_FACTS} SELECT fact_id, 'states: ' || array_to_string([a.role || '=' || a.name FOR a IN args], ', ') || '; example_id=' || example_id AS verbalized FROM f",
    "fact_entities": f"WITH {_FACTS}, u AS (SELECT fact_id, unnest(args) AS a FROM f) SELECT a.id AS entity_id, arg_min(a.name, {{'f': fact_id, 'n': a.name}}) AS name, count(DISTINCT fact_id) AS facts FROM u GROUP BY ALL",
    "fact_args_valid": f"""
WITH {_FACTS}, u AS (SELECT fact_id, unnest(args) AS a FROM f), k AS (SELECT a.id AS id FROM u GROUP BY ALL HAVING count(DISTINCT fact_id) > 1),
v AS (SELECT DISTINCT fact_id, a.role AS role, a.id AS id FROM u WHERE a.id IN (FROM k))
SELECT fact_id, count(*)::INT AS kept FROM v GROUP BY ALL HAVING count(DISTINCT id) >= 2""",
    "gold_facts": f"WITH {_FACTS}, g AS (SELECT DISTINCT example_id, s.passage_id AS p, s.sentence_index AS i FROM (SELECT example_id, unnest(supporting_facts) AS s FROM ({EXAMPLES}))) SELECT f.example_id, fact_id FROM f JOIN g ON g.example_id = f.example_id AND g.p = f.passage_id AND g.i = f.i",
    "multihop_filter": f"""
WITH e AS ({EXAMPLES}), p AS ({PASSAGES}), s AS (SELECT DISTINCT example_id, s.passage_id AS passage_id FROM (SELECT example_id, unnest(supporting_facts) AS s FROM e)),
t AS (SELECT s.example_id, count(DISTINCT title) AS titles FROM s JOIN p USING (passage_id) GROUP BY ALL), n AS (SELECT example_id, count(*) AS passages FROM p GROUP BY ALL)
SELECT example_id, coalesce(titles, 0) AS titles, coalesce(passages, 0) AS passages, coalesce(titles, 0) >= 2 AS explicit, coalesce(titles, 0) >= 2 AND coalesce(passages, 0) = 10 AS distractor FROM e LEFT JOIN t USING (example_id) LEFT JOIN n USING (example_id)""",
    "context_build": f"""
WITH {_FACTS}, e AS (SELECT example_id, unnest(supporting_facts) AS s, generate_subscripts(supporting_facts, 1) AS rank FROM ({EXAMPLES})),
b AS (SELECT e.example_id, rank, '[Evidence ' || fact_id || ']' || chr(10) || 'Source: ' || title || ', ' || title || chr(10) || 'Fact: states' || chr(10) || 'Original text: ' || sentence AS b, fact_id
  FROM e JOIN f ON f.passage_id = s.passage_id AND f.i = s.sentence_index WHERE rank <= 12)
SELECT example_id, count(*)::INT AS facts, string_agg(b, chr(10) || chr(10) ORDER BY rank, fact_id) AS context FROM b GROUP BY ALL""",
    "context_fit": f"""
WITH b AS (SELECT example_id, passage_id, concat_ws(chr(10), title, array_to_string(list_filter(sentences, lambda x: x IS NOT NULL), ' ')) AS body FROM ({PASSAGES}) WHERE example_id IS NOT NULL),
t AS (SELECT *, greatest(1, (length(body) + 3) // 4) AS t FROM b), l AS (SELECT *, 200 - coalesce(sum(t) OVER (PARTITION BY example_id ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t)
SELECT example_id, passage_id, least(length(body), CASE WHEN t > room THEN room * 4 ELSE length(body) END)::INT AS kept, least(t, room)::BIGINT AS tokens FROM l WHERE room > 0""",
    "suite_merge": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC NULLS LAST, ingested_at DESC NULLS LAST, doc_id DESC) AS i FROM documents WHERE document_id IS NOT NULL) SELECT document_id, version, ingested_at, doc_id, title FROM r WHERE i = 1",
    "reuse_audit": """
WITH a AS (SELECT title, min(doc_id) AS old_id FROM documents WHERE version = 1 GROUP BY ALL HAVING count(*) = 1), b AS (SELECT title, min(doc_id) AS new_id FROM documents WHERE version > 1 GROUP BY ALL HAVING count(*) = 1)
SELECT old_id, new_id FROM a JOIN b ON a.title IS NOT DISTINCT FROM b.title""",
    "fact_dedup": "SELECT query_id, fact_id, max(score) AS score FROM scored_facts WHERE query_id IS NOT NULL AND fact_id IS NOT NULL AND rank IS NOT NULL AND NOT isnan(coalesce(score, 0)) GROUP BY ALL",
    "fixed_sample": "SELECT example_id, sha256('42:' || example_id) AS h FROM (SELECT DISTINCT example_id FROM benchmark_examples WHERE example_id IS NOT NULL) ORDER BY h LIMIT 100",
    "stratified_sample": f"""
WITH d AS (SELECT doc_id, {_KEY.format("domain")} AS domain FROM documents), n AS (SELECT domain, row_number() OVER (ORDER BY sha256('42:' || domain)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT domain FROM d WHERE domain IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha256('42:' || doc_id)) AS i FROM d WHERE domain IS NOT NULL)
SELECT domain, doc_id FROM r JOIN n USING (domain) WHERE i <= 120 // n + (place <= 120 % n)::INT""",
    "chunk_offsets": f"""
WITH {_WINDOWS} SELECT section_id, k::INT AS chunk_no, coalesce(list_sum([length(x) + 1 FOR x IN t[1:(k * 24)]]), 0)::INT AS start_char,
  (coalesce(list_sum([length(x) + 1 FOR x IN t[1:(k * 24)]]), 0) + list_sum([length(x) + 1 FOR x IN t[(k * 24 + 1):(k * 24 + 32)]]) - 1)::INT AS end_char FROM w""",
    "chunk_ids": f"WITH {_WINDOWS} SELECT section_id, k::INT AS chunk_no, 'chunk_' || substr(sha1(section_id || ':' || k), 1, 16) AS chunk_id, sha256(array_to_string(t[(k * 24 + 1):(k * 24 + 32)], ' ')) AS digest FROM w",
}
