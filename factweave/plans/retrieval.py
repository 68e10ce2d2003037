"""Retrieval: channels, candidates, passages, bands, reranking and paths, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.operators import graph, ranking, vectors
from factweave.sources.tables import table

CHANNELS = ("bm25", "dense", "graph_full", "graph_multi")
WEIGHTS = {"bm25": 0.1, "dense": 0.2, "graph_full": 0.3, "graph_multi": 0.4}
DIM = 64


def incidence(spark: SparkSession, folder: str) -> DataFrame:
    """Facts are orders; their entities are the customer (weight 1) and the parts (1 + discount)."""
    o = table(spark, folder, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("entity"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("fact"), F.lit(1.0).alias("weight"))
    items = table(spark, folder, "lineitem")
    return o.unionByName(items.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("entity"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("fact"), (1 + F.col("l_discount")).alias("weight")))


def _channels(spark: SparkSession, folder: str, k: int = 40) -> DataFrame:
    """query_id, object_id, channel, rank: the k best facts of each query and channel by score."""
    d = table(spark, folder, "scored_facts").dropna(subset=["query_id", "fact_id", "score", "source"]).where(~F.isnan("score"))
    d = d.groupBy("query_id", "source", "fact_id").agg(F.max("score").alias("score"))
    d = ranking.top(d, ["query_id", "source"], [F.col("score").desc(), F.col("fact_id")], k)
    return d.select("query_id", F.col("fact_id").alias("object_id"), F.col("source").alias("channel"), "rank")


def fact_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The four channels fused, the first 40 facts of each query."""
    d = ranking.fuse(_channels(spark, folder))
    return ranking.top(d, ["query_id"], [F.col("score").desc(), F.col("object_id")], 40)


def band_fusion(spark: SparkSession, folder: str) -> DataFrame:
    d = ranking.fuse(_channels(spark, folder), WEIGHTS)
    return ranking.top(d, ["query_id"], [F.col("score").desc(), F.col("object_id")], 20)


def ablation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, method, kept: how many of the first 20 facts of all channels stay without one of them."""
    hits = _channels(spark, folder)
    best = lambda d: ranking.top(ranking.fuse(d), ["query_id"], [F.col("score").desc(), F.col("object_id")], 20).select("query_id", "object_id")
    without = reduce(DataFrame.unionByName, [best(hits.where(F.col("channel") != c)).withColumn("method", F.lit(f"no_{c}")) for c in CHANNELS])
    return without.join(best(hits), ["query_id", "object_id"]).groupBy("query_id", "method").agg(F.count(F.lit(1)).alias("kept"))


def best_per_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The first 10 facts of each query by greatest score, the smallest rank it has there, and id."""
    d = table(spark, folder, "scored_facts").dropna(subset=["query_id", "fact_id", "score", "rank"]).where(~F.isnan("score"))
    return ranking.rank_facts(d.select("query_id", "fact_id", F.when(F.col("score") == 0, 0.0).otherwise(F.col("score")).alias("score"), "rank"), 10)


def _supplied(spark: SparkSession, folder: str) -> DataFrame:
    """Facts are lines of orders, queries every twentieth supplier; the score is the price."""
    d = table(spark, folder, "lineitem").where(F.col("l_suppkey") % 20 == 0)
    return d.select(F.col("l_suppkey").alias("query_id"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("rank"), "l_orderkey", "l_discount")


def passage_max(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as passages of the 50 best facts of a query."""
    d = _supplied(spark, folder)
    f = ranking.rank_facts(d, 50)
    return ranking.passages_of(f, d.select("fact_id", F.concat(F.lit("o"), F.col("l_orderkey")).alias("passage_id")).distinct())


def fact_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best facts of a query in the order of their discount."""
    d = _supplied(spark, folder)
    f = ranking.rank_facts(d, 50).join(d.select("fact_id", "l_discount").distinct(), "fact_id")
    return ranking.rerank(f.select("query_id", "fact_id", "rank", "l_discount"), F.col("l_discount")).select("query_id", "fact_id", "rank", "first_rank", "score")


def _order_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The 8 dearest orders of every twentieth supplier."""
    d = _supplied(spark, folder).groupBy("query_id", F.concat(F.lit("o"), F.col("l_orderkey")).alias("object_id")).agg(F.round(F.max("score") / 1e6, 8).alias("score"))
    return ranking.top(d, ["query_id"], [F.col("score").desc(), F.col("object_id")], 8)


def graph_rerank(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.rerank(_order_hits(spark, folder).drop("rank"), graph.symmetric(incidence(spark, folder)))
    return d.select("query_id", "object_id", F.round("score", 6).alias("score"), "rank")


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.best_path(_order_hits(spark, folder), graph.symmetric(incidence(spark, folder)))
    return d.select("query_id", F.array_join("path", ">").alias("path"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as facts of two entities each (by label, by number), their bands, and every twentieth as a query."""
    v = table(spark, folder, "embeddings")
    entity = F.explode(F.array(F.concat(F.lit("l"), F.col("label"), F.lit("_"), F.col("vec_id") % 50), F.concat(F.lit("n"), F.floor(F.col("vec_id") / 4))))
    edges = graph.symmetric(v.select(entity.alias("entity"), F.concat(F.lit("v"), F.col("vec_id")).alias("fact"), F.lit(1.0).alias("weight")))
    bands = graph.vector_bands(edges, v.select(F.concat(F.lit("v"), F.col("vec_id")).alias("node"), F.col("embedding").alias("v")), DIM)
    return v, bands, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The first place and the length of every band of every node."""
    _, bands, _ = _vectors(spark, folder)
    return bands.select("node", "band", F.round(F.col("v")[0], 6).alias("first"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


def _gates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v, bands, q = _vectors(spark, folder)
    near = vectors.cosine_top(v.select("vec_id", "embedding"), q, 64)
    w = W.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / 0.05)
    seeds = near.withColumn("e", e).select("query_id", F.concat(F.lit("v"), F.col("vec_id")).alias("node"), (F.col("e") / F.sum("e").over(w)).alias("weight"))
    q = q.withColumnRenamed("embedding", "v")
    return graph.band_gate(seeds, bands, q, DIM), q


def band_gate(spark: SparkSession, folder: str) -> DataFrame:
    gates, _ = _gates(spark, folder)
    return gates.select("query_id", "band", F.round("gate", 4).alias("gate"))


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    d = graph.query_vectors(*_gates(spark, folder))
    return d.select("query_id", F.size("v").alias("places"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def internal_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical and the dense channel alone: their first 10 facts of each query."""
    d = _channels(spark, folder, 10).where(F.col("channel").isin("bm25", "dense"))
    return d.select("query_id", F.col("channel").alias("method"), "object_id", "rank")


QUERIES = {f.__name__: f for f in (
    internal_baselines, fact_candidates, band_fusion, ablation_matrix, best_per_fact, passage_max, fact_rerank, graph_rerank, shortest_path, vector_bands, band_gate, query_vectors)}

_EDGES = """
i AS (SELECT 'c' || o_custkey AS e, 'o' || o_orderkey AS f FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_discount IS NOT NULL),
edges AS (SELECT e AS src, f AS dst FROM i UNION ALL SELECT f, e FROM i)"""
_CHANNELS = """
b AS (SELECT query_id, source, fact_id, max(score) AS score FROM scored_facts WHERE query_id IS NOT NULL AND fact_id IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, fact_id) AS rank FROM b) WHERE rank <= 40)"""
_TOP = "SELECT query_id, object_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id))::INT AS rank FROM ({0})) WHERE rank <= {1}"
_FUSED = "SELECT query_id, fact_id AS object_id, round(sum({0} / (60 + rank)), 9) AS score FROM c {1} GROUP BY ALL"
_CASE = "(CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " END)"


def _without(channel: str) -> str:
    return f"WHERE source <> '{channel}'"


_SUPPLIED = """
s AS (SELECT l_suppkey AS query_id, l_orderkey || '#' || l_linenumber AS fact_id, l_extendedprice AS score, l_linenumber AS rank, l_orderkey, l_discount FROM lineitem WHERE l_suppkey % 20 = 0),
bf AS (SELECT query_id, fact_id, max(score) AS score, arg_min(rank, {'s': -score, 'r': rank}) AS first_rank FROM s GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, fact_id))::INT AS rank FROM bf) WHERE rank <= 50)"""
_HITS = """
h0 AS (SELECT l_suppkey AS query_id, 'o' || l_orderkey AS object_id, round(max(l_extendedprice) / 1000000, 8) AS score FROM lineitem WHERE l_suppkey % 20 = 0 GROUP BY ALL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM h0) WHERE rank <= 8)"""
_WALKS = """
w0 AS (SELECT DISTINCT object_id AS a, object_id AS z, [object_id] AS w FROM h), w1 AS (SELECT a, dst AS z, list_append(w, dst) AS w FROM w0 JOIN edges ON src = z),
w2 AS (SELECT a, dst AS z, list_append(w, dst) AS w FROM w1 JOIN edges ON src = z WHERE NOT list_contains(w, dst)), walks AS (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2)"""
_BANDS = """
iv AS (SELECT DISTINCT e, f FROM (SELECT 'l' || label || '_' || (vec_id % 50) AS e, 'v' || vec_id AS f FROM embeddings UNION ALL SELECT 'n' || (vec_id // 4), 'v' || vec_id FROM embeddings)),
ed AS (SELECT e AS src, f AS dst FROM iv UNION ALL SELECT f, e FROM iv), g AS (SELECT src, count(*) + 1.0::DOUBLE AS d FROM ed GROUP BY ALL),
p AS (SELECT ed.src, ed.dst, 1 / sqrt(x.d * y.d) AS w FROM ed JOIN g x ON x.src = ed.src JOIN g y ON y.src = ed.dst UNION ALL SELECT src, src, 1 / d FROM g),
x AS (SELECT 'v' || vec_id AS node, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
n AS (SELECT src AS node, k FROM g, (SELECT DISTINCT k FROM x)), r AS (SELECT n.node, n.k, coalesce(x.v, 0) AS v FROM n LEFT JOIN x USING (node, k)),
z1 AS (SELECT p.src AS node, r.k, sum(p.w * r.v) AS v FROM p JOIN r ON r.node = p.dst GROUP BY ALL), z2 AS (SELECT p.src AS node, z1.k, sum(p.w * z1.v) AS v FROM p JOIN z1 ON z1.node = p.dst GROUP BY ALL),
t AS (SELECT r.node, r.k, r.v AS raw, z2.v AS low, z1.v - z2.v AS mid, r.v - z1.v AS high FROM r JOIN z1 USING (node, k) JOIN z2 USING (node, k)),
b AS (UNPIVOT t ON raw, low, mid, high INTO NAME band VALUE v)"""
_GATES = """
ve AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.x, v.x) / (greatest(sqrt(list_dot_product(q.x, q.x)), 1e-12) * greatest(sqrt(list_dot_product(v.x, v.x)), 1e-12)), 6) AS score FROM ve q JOIN ve v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
sk AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.05) AS e FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS i FROM sc) WHERE i <= 64),
sw AS (SELECT query_id, 'v' || vec_id AS node, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM sk),
po AS (SELECT query_id, band, k, sum(weight * v) AS v FROM sw JOIN b USING (node) GROUP BY ALL),
qx AS (SELECT vec_id AS query_id, unnest(embedding)::DOUBLE AS q, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE vec_id % 20 = 0),
cs AS (SELECT query_id, band, CASE WHEN sqrt(sum(v * v)) <= 1e-12 THEN -1 ELSE sum(v * q) / (greatest(sqrt(sum(v * v)), 1e-12) * greatest(sqrt(sum(q * q)), 1e-12)) END AS c FROM po JOIN qx USING (query_id, k) GROUP BY ALL),
ga AS (SELECT query_id, band, exp(c) / sum(exp(c)) OVER (PARTITION BY query_id) AS gate FROM cs)"""

SQL = {
    "internal_baselines": f"WITH {_CHANNELS} SELECT query_id, source AS method, fact_id AS object_id, rank::INT AS rank FROM c WHERE source IN ('bm25', 'dense') AND rank <= 10",
    "fact_candidates": f"WITH {_CHANNELS} {_TOP.format(_FUSED.format('1.0::DOUBLE', ''), 40)}",
    "band_fusion": f"WITH {_CHANNELS} {_TOP.format(_FUSED.format(_CASE, ''), 20)}",
    "ablation_matrix": f"WITH {_CHANNELS}, al AS ({_TOP.format(_FUSED.format('1.0::DOUBLE', ''), 20)}), m AS ("
    + " UNION ALL ".join(f"SELECT *, 'no_{c}' AS method FROM ({_TOP.format(_FUSED.format('1.0::DOUBLE', _without(c)), 20)})" for c in CHANNELS)
    + ") SELECT query_id, method, count(*) AS kept FROM m WHERE EXISTS (SELECT 1 FROM al WHERE al.query_id = m.query_id AND al.object_id = m.object_id) GROUP BY ALL",
    "best_per_fact": """
WITH b AS (SELECT query_id, fact_id, max(score) AS score, arg_min(rank, {'s': -score, 'r': rank}) AS first_rank FROM (SELECT query_id, fact_id, CASE WHEN score = 0 THEN 0 ELSE score END AS score, rank FROM scored_facts WHERE query_id IS NOT NULL AND fact_id IS NOT NULL AND rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, fact_id))::INT AS rank FROM b) WHERE rank <= 10""",
    "passage_max": f"""
WITH {_SUPPLIED}, m AS (SELECT DISTINCT fact_id, 'o' || l_orderkey AS passage_id FROM s), b AS (SELECT query_id, passage_id, max(score) AS score, arg_min(rank, {{'s': -score, 'r': rank}}) AS r FROM f JOIN m USING (fact_id) GROUP BY ALL)
SELECT query_id, passage_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, passage_id))::INT AS rank FROM b""",
    "fact_rerank": f"""
WITH {_SUPPLIED}, m AS (SELECT DISTINCT fact_id, l_discount FROM s)
SELECT query_id, fact_id, (row_number() OVER (PARTITION BY query_id ORDER BY l_discount DESC, rank, fact_id))::INT AS rank, rank AS first_rank, l_discount AS score FROM f JOIN m USING (fact_id)""",
    "graph_rerank": f"""
WITH {_EDGES}, {_HITS}, {_WALKS}, r AS (SELECT DISTINCT a, z FROM walks),
o AS (SELECT query_id, object_id, z FROM h JOIN r ON a = object_id), l AS (SELECT DISTINCT x.query_id, x.object_id, y.object_id AS other FROM o x JOIN o y ON x.query_id = y.query_id AND x.z = y.z AND x.object_id <> y.object_id),
n AS (SELECT query_id, object_id, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT query_id, object_id, round(score + 0.05::DOUBLE * coalesce(n, 0), 6) AS score, score + 0.05::DOUBLE * coalesce(n, 0) AS e FROM h LEFT JOIN n USING (query_id, object_id))
SELECT query_id, object_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY e DESC, object_id))::INT AS rank FROM s""",
    "shortest_path": f"""
WITH {_EDGES}, {_HITS}, {_WALKS}, o AS (SELECT query_id, rank, z, w FROM h JOIN walks ON a = object_id),
l AS (SELECT x.query_id, x.rank AS i, y.rank AS j, list_concat(x.w, list_reverse(y.w)[2:]) AS path FROM o x JOIN o y ON x.query_id = y.query_id AND x.z = y.z AND x.rank < y.rank),
m AS (SELECT query_id, min({{'i': i, 'j': j, 'n': len(path), 'path': path}}) AS m FROM l GROUP BY ALL)
SELECT query_id, coalesce(array_to_string(m.path, '>'), object_id) AS path FROM h LEFT JOIN m USING (query_id) WHERE rank = 1""",
    "vector_bands": f"WITH {_BANDS} SELECT node, band, round(max(v) FILTER (k = 1), 6) AS first, round(sqrt(sum(v * v)), 6) AS length FROM b GROUP BY ALL",
    "band_gate": f"WITH {_BANDS}, {_GATES} SELECT query_id, band, round(gate, 4) AS gate FROM ga",
    "query_vectors": f"WITH {_BANDS}, {_GATES} SELECT query_id, count(*)::INT AS places, round(sum(gate * CASE WHEN band = 'raw' THEN q ELSE v END), 6) AS total FROM po JOIN ga USING (query_id, band) JOIN qx USING (query_id, k) GROUP BY ALL",
}
