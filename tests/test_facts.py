import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import corpus, facts, graph


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(("name", "want"), [("  Straße\u00a0No. 1 ", "strasse no 1"), ("ﬁne+Tune-d", "fine+tune-d"), (None, None), ("", ""), ("...", "")])
def test_normalize_name(spark, name, want):
    assert _one(spark, name, text.normalize_name) == want


def test_small_text_functions(spark):
    assert _one(spark, " Data Set (v2) ", lambda c: text.slug(c, "entity")) == "data_set_v2" and _one(spark, "--", lambda c: text.slug(c, "entity")) == "entity" and _one(spark, None, lambda c: text.slug(c, "entity")) == "entity"
    assert _one(spark, "a b/c.d-e", text.safe_id) == "a_b_c.d-e" and _one(spark, "", text.safe_id) == "item"
    assert [_one(spark, v, text.confidence) for v in ("0.25", "7", "-1", "x", None, "NaN")] == [0.25, 1.0, 0.0, 0.5, 0.5, 0.5]
    assert _one(spark, "A b. C d!\nE\n\n f? ", text.split_sentences) == ["A b.", "C d!", "E", "f?"]
    x = "ex_1"
    assert _one(spark, x, text.unit_interval) == pytest.approx(int(hashlib.sha256(x.encode()).hexdigest()[:16], 16) / 2**64)


@pytest.mark.parametrize(
    ("value", "want"),
    [('{"b":1,"a":[1]}', '{"a":[1],"b":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('Sure: {"a": "}"} done', '{"a":"}"}'), ("[1]", None), ("{broken", None), ("{x} {\"a\":1}", '{"a":1}'), (None, None), ("", None)],
)
def test_json_object(spark, value, want):
    assert _one(spark, value, text.repaired_json) == want


def test_digest_ignores_order_and_blanks(spark):
    assert _one(spark, '{"b": 1, "a": "é"}', text.json_digest) == _one(spark, '{"a":"é","b":1}', text.json_digest) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    assert _one(spark, "{", text.json_digest) is None and _one(spark, None, text.json_digest) is None


def test_quotes_are_found_whatever_the_whitespace(spark):
    rows = [("The cache\n reduces  load.", "cache reduces load", "cache\n reduces  load"), ("abc", "b", "b"), ("abc", "x", None), (None, "x", None), ("abc", " ", None), ("A.B", "A B", None)]
    d = spark.createDataFrame(rows, "t string, q string, want string").withColumn("got", text.grounded("t", "q")).withColumn("at", text.offsets("t", "q"))
    got = d.collect()
    assert [r.got for r in got] == [r[2] for r in rows] and got[1]["at"] == [1] and got[3]["at"] == []


def test_concepts(spark):
    s = "In Brief, the New York Stock Exchange's cache-layer reduces Backend load for Émile and users."
    assert _one(spark, s, lambda c: text.concepts(c, F.lit("Title X"), 20)) == ["Title X", "In Brief", "New York Stock Exchange's", "Backend", "Exchange's", "cache-layer", "reduces"]
    assert _one(spark, "", lambda c: text.concepts(c, F.lit(None).cast("string"))) == [] and _one(spark, "a b", lambda c: text.concepts(c, F.lit("T"))) == ["T"]


def test_sentence_facts(spark):
    d = spark.createDataFrame([("e", "p", "Request Cache", ["A request cache reduces load.", None, "Reads."]), ("e", "q", None, [""]), ("e", "r", "T", None)], "example_id string, passage_id string, title string, sentences array<string>")
    f = facts.sentence_facts(d)
    got = {(r.passage_id, r.sentence_index): r for r in f.collect()}
    assert sorted(got) == [("p", 0), ("p", 1), ("p", 2), ("q", 0)] and [got["p", i].start_char for i in range(3)] == [0, 30, 31]
    chunk = "chunk_" + hashlib.sha1(b"e:p:0").hexdigest()[:16]
    first = got["p", 0]
    assert first.chunk_id == chunk and first.fact_id == "fact_" + hashlib.sha1(chunk.encode()).hexdigest()[:16]
    assert [(a.role, a.name) for a in first.arguments][:3] == [("source", "Request Cache"), ("mention", "Request Cache"), ("mention", "A")]
    assert [a.role for a in got["q", 0].arguments] == ["source", "statement"] and got["q", 0].arguments[1].name == "sentence 0"
    text_of = f.where("passage_id = 'q'").select(facts.verbalized(F.lit("states"), F.col("arguments"), F.create_map(F.lit("k"), F.lit(None).cast("string"))).alias("t")).first().t
    assert text_of == "states: source=, statement=sentence 0"


def test_arguments_need_two_known_entities(spark):
    rows = [("f1", [("a", "x", "X"), ("a", "x", "X"), ("b", "y", "Y"), ("c", "zz", "Z")]), ("f2", [("a", "x", "X"), ("b", "x", "X")]), ("f3", []), ("f4", None)]
    d = spark.createDataFrame(rows, "fact_id string, arguments array<struct<role:string,entity_id:string,name:string>>")
    got = {r.fact_id: [(a.role, a.entity_id) for a in r.arguments] for r in facts.valid_arguments(d, spark.createDataFrame([("x",), ("y",)], "entity_id string")).collect()}
    assert got == {"f1": [("a", "x"), ("b", "y")]}


def test_entities_are_merged_by_name_and_type(spark):
    rows = [("Beta  Corp", "org", 2), ("BETA corp.", "org", 1), ("beta corp", "person", 3), (" ", "org", 4), (None, "org", 5), ("Beta  Corp", "org", 9)]
    d = facts.canonical_entities(spark.createDataFrame(rows, "name string, entity_type string, at int"))
    assert {(r.entity_type, r.entity): (r.canonical_name, r.aliases, r.mentions) for r in d.collect()} == {("org", "beta corp"): ("BETA corp.", ["BETA corp.", "Beta  Corp"], 3), ("person", "beta corp"): ("beta corp", ["beta corp"], 1)}


def test_the_best_or_the_last_of_repeated_rows(spark):
    d = spark.createDataFrame([("a", 0.5, 1, "x"), ("a", 0.9, 3, "y"), ("a", 0.9, 2, "z"), ("b", None, 1, "n"), (None, 1.0, 9, "k")], "k string, s double, o int, v string")
    assert sorted((r.k, r.v) for r in facts.dedup_facts(d, ["k"], "s", "o").where("k is not null").collect()) == [("a", "z"), ("b", "n")]
    assert sorted((r.k, r.v) for r in facts.last_written(d, "k", ["o"]).collect()) == [("a", "y"), ("b", "n")]


def test_context_counts_facts_and_fits_the_budget(spark):
    rows = [("e", i, f"f{i}", "T", "S", 3 if i == 1 else None, "states", f"s{i}") for i in range(1, 15)]
    d = spark.createDataFrame(rows, "example_id string, rank int, fact_id string, title string, section string, page int, predicate string, sentence string")
    (r,) = facts.evidence_context(d).collect()
    assert r.facts == 12 and r.context.startswith("[Evidence f1]\nSource: T, S, page 3\nFact: states\nOriginal text: s1\n\n[Evidence f2]\nSource: T, S\nFact")
    d = spark.createDataFrame([("g", 1, "x" * 10), ("g", 2, "y" * 100), ("g", 3, "z"), ("h", 1, None), ("h", 2, "")], "g string, r int, t string")
    assert sorted(tuple(x) for x in facts.fit_context(d, "g", "r", "t", 8).collect()) == [("g", 1, "x" * 10, 3), ("g", 2, "y" * 20, 5), ("h", 2, "", 1)]


def test_sections_without_a_first_heading_or_end(spark):
    d = spark.createDataFrame([(1, "# A #\nx"), (2, "a\n  ## B"), (3, ""), (4, "#\n \n# C\n\ny\n")], "k int, t string")
    assert sorted((r.k, r.section_no, r.title, r.text) for r in corpus.sections(d, "k", "t").collect()) == [(1, 1, "A", "x"), (2, 0, "Document", "a"), (4, 2, "C", "\ny\n")]


def test_placed_windows(spark):
    d = spark.createDataFrame([(1, "aa b, ccc d"), (2, None)], "k int, t string")
    got = [(r.chunk_no, r.start_char, r.end_char) for r in corpus.placed_windows(d, "k", "t", 3, 1).orderBy("chunk_no").collect()]
    assert got == [(0, 0, 6), (1, 5, 12)]  # aa b , ccc d


def _graph(spark, pairs):
    return graph.symmetric(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "entity string, fact string, weight double"))


def test_reified_graph(spark):
    rows = [("f1", 0.5, [("a", "x"), ("b", "y"), ("c", "x")]), ("f2", 0.0, [("a", "x"), ("b", "y")]), ("f3", None, [("a", "x")]), ("f4", 1.0, [("a", "unknown"), ("b", "y")])]
    d = spark.createDataFrame(rows, "fact_id string, confidence double, arguments array<struct<role:string,entity_id:string>>")
    nodes, edges = graph.reified(d, spark.createDataFrame([("x",), ("y",)], "entity_id string"))
    assert sorted(tuple(r) for r in edges.collect()) == [("f1", "x", "c", 0.5), ("f1", "y", "b", 0.5), ("f4", "y", "b", 1.0)]
    assert nodes.groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 2 and nodes.count() == 6


def test_vector_bands_and_gate_against_matrices(spark):
    r = np.random.default_rng(2)
    pairs = [("e1", "f1"), ("e1", "f2"), ("e2", "f2"), ("e2", "f3")]
    x = {f"f{i}": r.normal(size=3) for i in (1, 2, 3)}
    names = ["e1", "e2", "f1", "f2", "f3"]
    a = np.eye(5)
    for e, f in pairs:
        a[names.index(e), names.index(f)] = a[names.index(f), names.index(e)] = 1
    s = 1 / np.sqrt(a.sum(axis=1))
    p = a * s[:, None] * s
    raw = np.array([x.get(n, np.zeros(3)) for n in names])
    want = {"raw": raw, "low": p @ p @ raw, "mid": p @ raw - p @ p @ raw, "high": raw - p @ raw}
    feats = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in x.items()], "node string, v array<double>")
    b = graph.vector_bands(_graph(spark, pairs), feats, 3).cache()
    for row in b.collect():
        assert row.v == pytest.approx(want[row.band][names.index(row.node)])
    q = np.array([1.0, 0.0, 0.0])
    queries = spark.createDataFrame([(1, q.tolist())], "query_id int, v array<double>")
    gates = graph.band_gate(spark.createDataFrame([(1, "f1", 0.25), (1, "e2", 0.75)], "query_id int, node string, weight double"), b, queries, 3).cache()
    pooled = {k: 0.25 * v[2] + 0.75 * v[1] for k, v in want.items()}
    e = {k: np.exp(v @ q / np.linalg.norm(v)) for k, v in pooled.items()}
    assert {g.band: g.gate for g in gates.collect()} == pytest.approx({k: v / sum(e.values()) for k, v in e.items()})
    got = graph.query_vectors(gates, queries).first().v
    gate = {k: v / sum(e.values()) for k, v in e.items()}
    assert got == pytest.approx(np.concatenate([gate["raw"] * q, *(gate[k] * pooled[k] for k in ("low", "mid", "high"))]))


def test_rerank_and_path_by_hops(spark):
    edges = _graph(spark, [("a", "f1"), ("a", "f2"), ("b", "f2"), ("b", "f3"), ("c", "f4"), ("d", "f3"), ("d", "f5")])
    hits = spark.createDataFrame([("q", n, s, i) for i, (n, s) in enumerate([("f4", 1.0), ("f1", 0.9), ("f3", 0.9), ("f5", 0.5), ("lost", 0.4)], 1)] + [("r", "f4", 1.0, 1)], "query_id string, object_id string, score double, rank int")
    got = {(r.query_id, r.object_id): (round(r.score, 2), r["rank"]) for r in graph.rerank(hits.drop("rank"), edges).collect()}
    assert got == {("q", "f3"): (1.0, 1), ("q", "f4"): (1.0, 2), ("q", "f1"): (0.95, 3), ("q", "f5"): (0.55, 4), ("q", "lost"): (0.4, 5), ("r", "f4"): (1.0, 1)}
    path = {r.query_id: r.path for r in graph.best_path(hits, edges).collect()}
    assert path == {"q": ["f1", "a", "f2", "b", "f3"], "r": ["f4"]}


def test_labels_qualifiers_and_cuts(spark):
    d = spark.createDataFrame([("x [ab] y [a] [b]", ["a", "ab", None, "a"]), (None, None)], "t string, l array<string>")
    assert [r[0] for r in d.select(text.without_labels(F.col("t"), F.col("l"))).collect()] == ["x   y   [b]", ""]
    q = spark.createDataFrame([('{"Time Span": " 1998 ", "n": 2.5, "ok": true, "none": null, "blank": " ", "deep": {"a": 1}, "list": [1]}',)], "v string").select(text.qualifiers(F.parse_json("v")).alias("q")).first().q
    assert q == {"time_span": "1998", "n": "2.5", "ok": "true", "none": None}
    c = spark.createDataFrame([("One two. Three four. Five", 12), ("abcdefgh", 3), (None, 3), ("", 3)], "t string, n int").select(text.cut_at_sentences("t", "n").alias("c")).collect()
    assert [r.c for r in c] == [["One two.", "Three four.", "Five"], ["abc", "def", "gh"], [], []]
    e = spark.createDataFrame([("A", "b", 1, 0), (None, None, 1, 4)], "n string, d string, x int, y int").select(text.entity_text(F.col("n"), F.col("d")).alias("e"), text.ratio(F.col("x"), F.col("y")).alias("r")).collect()
    assert [tuple(r) for r in e] == [("A. b", 0.0), (".", 0.25)]
    assert _one(spark, "x", text.derived_seed) == str(int(hashlib.sha256(b"x").hexdigest()[:16], 16))


def test_retrieval_from_passages_to_contexts(spark, tmp_path):
    from factweave import api

    p = spark.createDataFrame([("e", "p1", "Request Cache", ["A request cache reduces backend load.", "It is small."]), ("e", "p2", "Network", ["Congestion reduces availability."])], "example_id string, passage_id string, title string, sentences array<string>")
    index = api.build_index(api.Corpus.of(p))
    q = spark.createDataFrame([(1, "How does request caching reduce backend load?")], "query_id int, text string")
    hits = api.retrieve(index, q, 3).cache()
    best = hits.orderBy("rank").first()
    (c,) = api.contexts(index, hits).collect()
    assert c.context.startswith(f"[Evidence {best.fact_id}]\nSource: Request Cache, Request Cache\nFact: states\nOriginal text: A request cache")
    assert [r.passage_id for r in api.passages(index, hits).orderBy("rank").collect()][0] == "p1"
    assert api.retrieve(index, q, 3, hops=True).orderBy("rank").first().score == pytest.approx(best.score + 0.05 * (hits.count() - 1), abs=0.051)
    r = spark.createDataFrame([("s", "e", ["p1"]), ("t", "e", ["p2"])], "system string, example_id string, ranking array<string>")
    scores = api.evaluate(r, spark.createDataFrame([("e", ["p1"])], "example_id string, gold array<string>"))
    summary = api.summarize(scores, ["recall_1", "mrr"]).cache()
    assert {(x.system, x.metric): x["mean"] for x in summary.collect()} == {("s", "recall_1"): 1.0, ("s", "mrr"): 1.0, ("t", "recall_1"): 0.0, ("t", "mrr"): 0.0}
    api.write_report(scores, summary, str(tmp_path), "R", {"Retrieval": ["recall_1"]})
    assert "| s | 1.0000 [1.0000, 1.0000] (n=1) |" in [x.value for x in spark.read.text(str(tmp_path / "report.md")).collect()]
