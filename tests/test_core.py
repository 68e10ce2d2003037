import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.functions.answers import answer_tokens, f1
from factweave.operators import corpus, graph, limiter, ranking, scan, stats, vectors
from factweave.plans import queries


def _scores(spark, rows):
    d = spark.createDataFrame(rows, "r array<string>, g array<string>")
    return ranking.ranking_scores(d, "r", "g").collect()


def test_ranking_scores_count_repeats_once(spark):
    (row,) = _scores(spark, [(["a", "a", None, " ", "b"], ["a", "b"])])
    assert (row.recall_1, row.recall_3, row.mrr, row.ndcg_3) == (0.5, 1.0, 1.0, 1.0)
    assert row.precision_20 == pytest.approx(0.1) and row.returned_precision_20 == 1.0 and (row.complete_1, row.complete_3) == (0.0, 1.0)


def test_mrr_stops_at_20(spark):
    (row,) = _scores(spark, [([f"x{i}" for i in range(20)] + ["a"], ["a"])])
    assert row.mrr == row.mrr_20 == 0.0 and row.returned_precision_20 == 0.0


def test_ranking_scores_without_gold_or_ranking(spark):
    a, b, c = _scores(spark, [(["a"], []), (None, ["x"]), (["a"], None)])
    assert a.recall_5 is None and a.mrr is None and c.ndcg_5 is None
    assert (b.recall_5, b.mrr, b.ndcg_5) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    ("answer", "gold", "want"),
    [("request caching [fact_1]", "Request caching", 1.0), ("x y", "x y z w", 2 / 3), ("yes maybe", "yes", 0.0), ("", "", 1.0), (None, "x", 0.0), ("published [1998]", "published 1998", 1.0), ("x x", "x", 2 / 3)],
)
def test_answer_f1(spark, answer, gold, want):
    d = spark.createDataFrame([(answer, gold)], "a string, g string")
    assert d.select(f1(answer_tokens(F.col("a")), answer_tokens(F.col("g"))).alias("f")).first().f == pytest.approx(want)


def test_holm(spark):
    d = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.2)], "k string, p double"), "p", "k", "q")
    assert {r.k: round(r.q, 6) for r in d.collect()} == {"a": 0.03, "b": 0.06, "c": 0.2}


def test_rrf_leaves_nulls_out(spark):
    rows = [("q", "f", 1, "a"), ("q", "f", 2, "a"), ("q", "f", 1, "b"), ("q", None, 1, "a"), (None, "f", 1, "a"), ("q", "g", None, "a")]
    (row,) = ranking.rrf(spark.createDataFrame(rows, "query_id string, fact_id string, rank int, source string")).collect()
    assert row.fact_id == "f" and row.score == pytest.approx(2 / 61)


def test_windows_reach_the_end(spark):
    d = spark.createDataFrame([(1, " ".join("x" * n for n in [1] * 21)), (2, None), (3, ""), (4, "a b")], "k int, t string")
    got = [(r.k, r.chunk_no, len(r.tokens)) for r in corpus.windows(d, "k", "t", 10, 2).orderBy("k", "chunk_no").collect()]
    assert got == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (4, 0, 2)]
    with pytest.raises(ValueError):
        corpus.windows(d, "k", "t", 4, 4)


def test_sections(spark):
    d = spark.createDataFrame([(1, "before\n# One\na\nb\n#\nc\n## Blank\n \n"), (2, None)], "k int, t string")
    got = [(r.section_no, r.title, r.text) for r in corpus.sections(d, "k", "t").orderBy("section_no").collect()]
    assert got == [(0, "Document", "before"), (1, "One", "a\nb"), (2, "Untitled", "c")]


def test_bands_against_dense_matrix(spark):
    rows = [("e1", "f1", 1.0), ("e1", "f2", 0.5), ("e2", "f2", 2.0), ("e2", "f2", 1.0), (None, "f1", 1.0)]
    edges = graph.symmetric(spark.createDataFrame(rows, "entity string, fact string, weight double"))
    x = {"f1": 3.0, "f2": 1.0}
    got = {r.node: r for r in graph.bands(edges, spark.createDataFrame(list(x.items()), "node string, v double")).collect()}
    names = ["e1", "e2", "f1", "f2"]
    a = np.eye(4)
    for e, f, w in [("e1", "f1", 1.0), ("e1", "f2", 0.5), ("e2", "f2", 3.0)]:
        a[names.index(e), names.index(f)] = a[names.index(f), names.index(e)] = w
    s = 1 / np.sqrt(a.sum(axis=1))
    p = a * s[:, None] * s[None, :]
    v = np.array([x.get(n, 0.0) for n in names])
    for i, n in enumerate(names):
        assert got[n].low == pytest.approx((p @ p @ v)[i]) and got[n].mid == pytest.approx((p @ v - p @ p @ v)[i]) and got[n].high == pytest.approx((v - p @ v)[i])


def test_hops(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(6)], "entity string, fact string, weight double")
    d = graph.hops(graph.symmetric(chain), spark.createDataFrame([("n0",)], "node string"), 3)
    assert {r.node: r.hops for r in d.collect()} == {"n0": 0, "n1": 1, "n2": 2, "n3": 3}


def test_hops_of_every_seed(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(8)], "entity string, fact string, weight double")
    seeds = spark.createDataFrame([("n0",), ("n3",), ("n3",)], "node string")
    d = graph.seed_hops(graph.symmetric(chain), seeds, 3)
    got = [(r.seed, r.node, r.hops) for r in d.collect()]
    assert sorted(got) == sorted((f"n{s}", f"n{i}", abs(s - i)) for s in (0, 3) for i in range(9) if abs(s - i) <= 3)


def test_limiter_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice([1, 2, None]), r.randrange(600) * 500_000 + 3_599_900_000) for i in range(300)]
    rows += [(900, 7, 50_000_000), (901, 7, 60_000_000), (902, 7, 70_000_000), (903, 7, 110_000_000)]  # across a minute
    d = spark.createDataFrame(rows, "event_id int, user_id int, at bigint")
    d = limiter.admitted(limiter.trailing(d, "user_id", "at", 60_000_000), "user_id", "at", "event_id", 2, 60_000_000)
    got = {x.event_id: (x.trailing, x.admitted) for x in d.collect()}
    want, room = {}, {}
    for i, u, t in sorted(rows, key=lambda x: (x[2], x[0])):
        held = [x for x in room.get(u, []) if t - x < 60_000_000]
        want[i] = sum(v == u and 0 <= t - x < 60_000_000 for _, v, x in rows), len(held) < 2
        room[u] = held + [t] * (len(held) < 2)
    assert got == want and [got[i] for i in (900, 901, 902, 903)] == [(1, True), (2, True), (3, False), (3, True)]


def test_seed_weights_of_64_seeds(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(90, 6))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in queries.seed_weights_64(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.weight
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 90, 20):
        best = sorted((j for j in range(90) if j != q), key=lambda j: (-round(float(u[q] @ u[j]), 6), j))[:64]
        e = np.exp((u[best] @ u[q]) / 0.05)
        assert set(got[q]) == set(best) and [got[q][j] for j in best] == pytest.approx(e / e.sum(), abs=2e-5)


def test_cosine_against_brute_force_in_blocks(spark):
    m = np.random.default_rng(1).normal(size=(60, 8))
    m[7] = 0
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    q = d.where("vec_id % 6 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.cosine_top(d, q, 4, block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for i in range(0, 60, 6):
        assert got[i] == sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:4]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "cache cache load"), (2, "load load load"), (3, None), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "Cache load")], "query_id bigint, text string")
    rows = corpus.bm25(docs, q).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [1, 2] and all(math.isfinite(r.score) for r in rows)


def test_bm25_joins_where_many_terms_are_asked(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 17}" for k in range(1, 9))) for i in range(40)] + [(90, None), (91, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "t1 t2 t5"), (2, "t3"), (3, ""), (4, None)], "query_id bigint, text string")
    want = sorted(map(tuple, corpus.bm25(docs, q).collect()))
    assert corpus.bm25(docs, q.where("query_id > 2")).count() == 0 and corpus.bm25(docs.limit(0), q).count() == 0
    monkeypatch.setattr(corpus, "TERMS", 1)
    assert sorted(map(tuple, corpus.bm25(docs, q).collect())) == want and {r[0] for r in want} == {1, 2}


def test_running_sum_equals_a_window(spark):
    d = spark.range(500).select("id", (F.col("id") % 3).alias("g"), scan.shuffle_key(1, F.col("id")).alias("k"), F.col("id").alias("v"))
    got = scan.running_sum(d, ["g"], "k", "id", "v", "s").toPandas().sort_values(["g", "k", "id"])
    assert (got.groupby("g")["v"].cumsum() == got["s"]).all()
