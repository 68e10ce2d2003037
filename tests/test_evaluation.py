import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.functions.answers import answer_scores, answer_tokens, citation_ids, citation_status
from factweave.operators import external, ranking, stats


@pytest.mark.parametrize(
    ("answer", "references", "want"),
    [
        ("request caching [fact_123] [fact_456]", ["request caching"], (1, 1, 1, 1)), ("x y", ["x", "x y z w"], (0, 2 / 3, 1, 0.5)), ("yes maybe", ["yes"], (0, 0, 0, 0)),
        ("", [""], (1, 1, 1, 1)), ("x", [], (0, 0, 0, 0)), ("", [], (1, 1, 1, 1)), (None, None, (1, 1, 1, 1)), ("published [1998]", ["published 1998"], (1, 1, 1, 1)),
    ],
)
def test_answer_scores(spark, answer, references, want):
    d = spark.createDataFrame([(answer, references)], "a string, g array<string>")
    s = d.select(answer_scores(answer_tokens(F.col("a")), F.col("g")).alias("s")).first().s
    assert (s.em, s.f1, s.recall, s.precision) == pytest.approx(want)


def test_set_and_joint_scores(spark):
    rows = [(["s1", "wrong"], ["s1", "s2"]), (["a", "a", None], ["a"]), (None, ["a"]), ([], ["a"]), (["a"], []), (["a"], None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, g array<string>").withColumn("s", ranking.set_scores(F.col("p"), F.col("g")))
    got = [tuple(r.s) for r in d.orderBy("i").collect()]
    assert got == [(0.0, 0.5, 0.5, 0.5), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (None,) * 4, (None,) * 4]
    one = F.struct(*[F.lit(1.0).alias(c) for c in ("em", "precision", "recall", "f1")])
    j = [tuple(r.j) for r in d.withColumn("j", ranking.joint(one, F.col("s"))).orderBy("i").collect()]
    assert j == [(0.0, 0.5, 0.5, 0.5), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (None,) * 4, (None,) * 4]


def test_citations(spark):
    d = spark.createDataFrame([("a [fact_1] b [ fact_2 ] [x] [fact_1]",), (None,), ("",)], "a string")
    assert [r[0] for r in d.select(citation_ids(F.col("a"))).collect()] == [["fact_1", "fact_2"], [], []]
    cases = [("success", 1, 1, 0, True, False, "success"), ("success", 1, 1, 0, False, False, "no_gold_evidence"), ("missing", 0, 0, 0, True, False, "result_missing"), ("failed", 1, 0, 1, True, False, "citation_mapping_failed"),
             ("unscorable", 0, 0, 0, True, False, "result_failed"), ("success", 0, 0, 0, True, True, "citation_parse_failed"), ("success", 0, 0, 0, True, False, "citation_empty"), ("success", 1, 0, 1, True, False, "citation_invalid_id"), ("success", 2, 1, 1, True, False, "citation_mapping_failed")]
    d = spark.createDataFrame(cases, "s string, r int, v int, u int, g boolean, f boolean, want string")
    assert all(r.got == r.want for r in d.withColumn("got", citation_status(*(F.col(c) for c in "srvugf"))).collect())


def test_passages_of_facts(spark):
    facts = [("q", f"f{i}", 0.5, i) for i in range(1, 21)] + [("q", "g", 0.5, 21), ("q", "none", 9.0, 22)]
    d = spark.createDataFrame(facts, "query_id string, fact_id string, score double, rank int")
    p = spark.createDataFrame([(f"f{i}", "p1") for i in range(1, 21)] + [("g", "p2")], "fact_id string, passage_id string")
    assert [r.passage_id for r in ranking.passages_of(d, p).orderBy("rank").collect()] == ["p1", "p2"]
    tie = spark.createDataFrame([("q", "x", 0.5, 1), ("q", "y", 0.5, 1)], "query_id string, fact_id string, score double, rank int")
    p = spark.createDataFrame([("x", "passage_b"), ("y", "passage_a")], "fact_id string, passage_id string")
    assert [r.passage_id for r in ranking.passages_of(tie, p).orderBy("rank").collect()] == ["passage_a", "passage_b"]


def test_best_fact_has_the_greatest_score_then_the_smallest_rank(spark):
    rows = [("q", "a", 1.0, 5), ("q", "a", 1.0, 2), ("q", "a", 0.5, 1), ("q", "b", 1.0, 1), ("q", "c", 1.0, 2)]
    d = ranking.rank_facts(spark.createDataFrame(rows, "query_id string, fact_id string, score double, rank int"), 2)
    assert [(r.fact_id, r.first_rank) for r in d.orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    again = ranking.rerank(d.select("query_id", "fact_id", "rank"), F.when(F.col("fact_id") == "a", 3).otherwise(1))
    assert [(r.fact_id, r.first_rank) for r in again.orderBy("rank").collect()] == [("a", 2), ("b", 1)]


def test_fusion_of_unknown_channels_is_an_error(spark):
    d = spark.createDataFrame([("q", "f", 1, "x"), ("q", "f", 2, "y")], "query_id string, object_id string, rank int, channel string")
    assert ranking.fuse(d).first().score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert ranking.fuse(d, {"x": 0.5, "y": 0.1}).first().score == pytest.approx(0.5 / 61 + 0.1 / 62, abs=1e-8)
    with pytest.raises(Exception, match="unknown channel"):
        ranking.fuse(d, {"x": 1.0}).collect()


def test_bootstrap_interval_is_that_of_the_mean(spark):
    r = np.random.default_rng(1)
    x = r.normal(2.0, 1.0, 800)
    d = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 5.0), ("null", 1, None)], "system string, id bigint, v double")
    got = {g.system: g for g in stats.summarize(d, ["system"], "id", "v").collect()}
    half = 1.96 * x.std(ddof=1) / math.sqrt(len(x))
    s = got["s"]
    assert s.n == 800 and s.mean == pytest.approx(x.mean()) and s.ci95_low == pytest.approx(x.mean() - half, abs=0.02) and s.ci95_high == pytest.approx(x.mean() + half, abs=0.02)
    assert (got["one"].sd, got["one"].ci95_low, got["one"].ci95_high) == (None, 5.0, 5.0) and (got["null"].n, got["null"].mean, got["null"].ci95_low) == (0, None, None)
    assert stats.summarize(d.repartition(7), ["system"], "id", "v").where("system = 's'").first().ci95_low == pytest.approx(s.ci95_low)


def test_randomization_against_all_sign_flips(spark):
    x = [0.3, 0.1, -0.2, 0.4, 0.25, 0.05, 0.3, -0.1, 0.2, 0.15]
    d = spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "g string, id int, d double")
    flips = [abs(sum(v if k >> i & 1 else -v for i, v in enumerate(x))) for k in range(1 << len(x))]
    want = np.mean([f >= sum(x) - 1e-9 for f in flips])
    assert stats.randomization_p(d, ["g"], "id").first().p == pytest.approx(want, abs=0.02)
    same = spark.createDataFrame([("g", i, 0.0) for i in range(4)], "g string, id int, d double")
    assert stats.randomization_p(same, ["g"], "id", permutations=50).first().p == 1.0


def test_pairs_are_of_examples_that_all_systems_have(spark):
    rows = [("m", s, e, v) for s, e, v in (("a", 1, 1.0), ("b", 1, 0.5), ("c", 1, 0.25), ("a", 2, 1.0), ("b", 2, 1.0), ("c", 2, None), ("a", 3, 0.0), ("b", 3, 1.0), ("c", 3, 1.0))]
    d = stats.pair_differences(spark.createDataFrame(rows, "m string, s string, e int, v double"), "s", "e", "v", ["m"])
    assert sorted((r.system_a, r.system_b, r.e, r.d) for r in d.collect()) == [("a", "b", 1, 0.5), ("a", "b", 3, -1.0), ("a", "c", 1, 0.75), ("a", "c", 3, -1.0), ("b", "c", 1, 0.25), ("b", "c", 3, 0.0)]


def test_cohens_d_without_variance(spark):
    d = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("c", 0.5), ("c", 0.5), ("one", 1.0), ("x", 1.0), ("x", 0.0)], "g string, d double")
    got = {r.g: r.c for r in d.groupBy("g").agg(stats.cohens_d("d").alias("c")).collect()}
    assert got["z"] == 0.0 and math.isnan(got["c"]) and math.isnan(got["one"]) and got["x"] == pytest.approx(0.5 / math.sqrt(0.5))


def test_runs_are_collapsed_only_if_complete(spark):
    rows = [("a", 1, 1, 0.5, 1.0), ("a", 1, 2, 1.0, None), ("a", 2, 1, 0.5, 1.0)]
    d = stats.collapse_runs(spark.createDataFrame(rows, "s string, e int, run int, x double, y double"), ["s", "e"], "run", ["x", "y"], 2)
    assert sorted(tuple(r) for r in d.collect()) == [("a", 1, True, 0.75, None), ("a", 2, False, None, None)]


def test_rankings_in_the_suites_ids(spark):
    p = spark.createDataFrame([("e", "p1", "Result"), ("e", "p2", "Mechanism"), ("x", "p3", "Result")], "example_id string, passage_id string, title string")
    rows = [(1, "e", ["Result", "Mechanism", "p1"]), (2, "e", ["unknown-community", "p1"]), (3, "e", ["p3", None, "__unmapped__:z"]), (4, "e", None), (5, None, ["p1"])]
    d = external.normalized_ranking(spark.createDataFrame(rows, "result_id int, example_id string, document_ranking array<string>"), p)
    got = {}
    for r in d.orderBy("result_id", "rank").collect():
        got.setdefault(r.result_id, []).append(r.candidate)
    assert got == {1: ["p1", "p2"], 2: ["__unmapped__:unknown-community", "p1"], 3: ["__unmapped__:p3", "__unmapped__:", "__unmapped__:z"], 5: ["__unmapped__:p1"]}
    assert {r.result_id: r.coverage for r in external.coverage(d).collect()} == {1: 1.0, 2: 0.5, 3: 0.0, 5: 0.0}


def test_audit_keeps_missing_unknown_and_repeated_examples_apart(spark):
    rows = [("s", "a", "success"), ("s", "a", "failed"), ("s", "b", "unscorable"), ("s", "zz", "success"), ("s", "c", None)]
    r = spark.createDataFrame(rows, "system string, example_id string, status string")
    (x,) = external.audit(r, spark.createDataFrame([(i,) for i in "abcd"], "example_id string")).collect()
    assert (x.expected, x.received, x.missing, x.duplicates, x.unknown, x.succeeded, x.failed, x.unscorable) == (4, 3, 1, 1, 1, 1, 1, 1)


def test_packing_is_greedy(spark):
    r = random.Random(4)
    rows = [(g, i, r.choice([None, 0, 10, 90, 250])) for g in "ab" for i in range(40)]
    got = {(x.g, x.i): x.batch for x in external.packed(spark.createDataFrame(rows, "g string, i int, n int"), "g", ["i"], "n", 100).collect()}
    for g in "ab":
        no, used, held = 0, 0, False
        for _, i, n in (x for x in rows if x[0] == g):
            if held and used + (n or 0) > 100:
                no, used = no + 1, 0
            used, held = used + (n or 0), True
            assert got[g, i] == no


def test_candidates_of_any_form(spark):
    import json

    p = spark.createDataFrame([("e", "p1", "Result", 0), ("e", "p2", "Mechanism", 1), ("x", "p3", "Result", 0)], "example_id string, passage_id string, title string, pos int")
    records = [
        {"ranking": ["Result", "p2"]}, {"ranking": [1, {"index": 0}, {"id": "zz"}]}, {"contexts": [], "ranking": ["p1"]}, {"ranking": None, "contexts": ["p1"]}, {"other": 1},
        {"ranking": [{"community_id": "c", "sources": [{"title": "Mechanism"}, {"passages": ["p1", "nope"]}]}, {"entity_id": "e9", "chunks": ["nope"]}, "p2"]}, {"ranking": "p2"},
    ]
    d = spark.createDataFrame([(i, "e", json.dumps(r)) for i, r in enumerate(records)], "result_id int, example_id string, v string").select("result_id", "example_id", F.parse_json("v").alias("raw"))
    d = external.declared(d, ["contexts", "ranking"])
    assert [r.declared for r in d.orderBy("result_id").collect()] == [True, True, True, True, False, True, True]
    got = {}
    for r in external.mapped_candidates(d, p).orderBy("result_id", "rank").collect():
        got.setdefault(r.result_id, []).append(r.candidate)
    assert got == {0: ["p1", "p2"], 1: ["p2", "p1", "__unmapped__:zz"], 3: ["p1"], 5: ["p2", "p1", "__unmapped__:e9"], 6: ["p2"]}


def test_units_and_marked_documents(spark):
    r = spark.createDataFrame([(1, "f1", 1), (1, "f2", 2), (1, "f3", 3), (1, "zz", 4)], "result_id int, fact_id string, rank int")
    u = spark.createDataFrame([("f1", "b"), ("f2", "a"), ("f3", "b")], "fact_id string, unit string")
    assert [(x["rank"], x.unit) for x in external.units_of(r, u).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    assert [x.unit for x in external.units_of(r, u, "__unmapped_fact__:").orderBy("rank").collect()] == ["b", "a", "__unmapped_fact__:zz"]
    t = spark.createDataFrame([(1, "e", "see [d2] then [d1]"), (2, "e", None)], "result_id int, example_id string, text string")
    m = spark.createDataFrame([("e", "d1", "[d1]"), ("e", "d2", "[d2]"), ("e", "d3", "[d3]"), ("e", "d4", "")], "example_id string, document_id string, marker string")
    assert [tuple(x) for x in external.marked_ranking(t, m).orderBy("rank").collect()] == [(1, "d2", 1), (1, "d1", 2)]


def test_every_system_has_every_example(spark):
    r = spark.createDataFrame([("s", "a", 2, "failed"), ("s", "a", 1, "success"), ("t", "b", 3, "success")], "system string, example_id string, result_id int, status string")
    d = external.expected_results(r, spark.createDataFrame([("a",), ("b",)], "example_id string"), "result_id")
    assert sorted((x.system, x.example_id, x.status) for x in d.collect()) == [("s", "a", "success"), ("s", "b", "missing"), ("t", "a", "missing"), ("t", "b", "success")]
    assert external.expected_results(r.limit(0), spark.createDataFrame([("a",)], "example_id string"), "result_id").count() == 0
