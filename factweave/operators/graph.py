"""The reified fact graph as edge tables: degree, propagation, spectral bands, reach.

edges: src, dst, weight, both directions of every edge once. A node's rows meet in joins
on its key; adaptive skew handling splits the hot ones, and sums combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.session import cut


def symmetric(incidence: DataFrame) -> DataFrame:
    """Edges of (entity, fact, weight), summed where a pair repeats, in both directions."""
    one = incidence.dropna().groupBy("entity", "fact").agg(F.sum("weight").alias("weight"))
    return one.select(F.col("entity").alias("src"), F.col("fact").alias("dst"), "weight").unionByName(one.select(F.col("fact").alias("src"), F.col("entity").alias("dst"), "weight"))


def reified(facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (src, dst, role, weight) of facts (fact_id, arguments, confidence) and entities (entity_id).

    A fact is linked to each known entity once: of several roles the last one stays. Facts of confidence 0 or less, or null, have no edges.
    """
    nodes = entities.select(F.col("entity_id").alias("node"), F.lit("entity").alias("kind")).distinct().unionByName(facts.select(F.col("fact_id").alias("node"), F.lit("fact").alias("kind")).distinct())
    d = facts.where(F.col("confidence") > 0).select("fact_id", "confidence", F.posexplode("arguments").alias("pos", "a")).withColumn("entity_id", F.col("a.entity_id"))
    d = d.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    d = d.groupBy("entity_id", "fact_id").agg(F.max_by("a.role", "pos").alias("role"), F.max("confidence").alias("weight"))
    return nodes, d.select(F.col("fact_id").alias("src"), F.col("entity_id").alias("dst"), "role", "weight")


def normalized(edges: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 as src, dst, weight."""
    deg = cut(edges.groupBy("src").agg((F.sum("weight") + 1.0).alias("deg")))
    d = edges.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst")
    d = d.select("src", "dst", (F.col("weight") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("weight"))
    return d.unionByName(deg.select("src", F.col("src").alias("dst"), (1.0 / F.col("deg")).alias("weight")))


def propagate(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """node, v: the matrix times the vector; nodes absent from x count as 0."""
    d = matrix.join(x.select(F.col("node").alias("dst"), "v"), "dst")
    return d.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def bands(edges: DataFrame, x: DataFrame) -> DataFrame:
    """node, raw, low, mid, high of every node of the graph: low = P P x, mid = P x - low, high = x - P x.

    Raw, P x and P P x come together by one sum per node; nodes of x outside the graph are left out.
    """
    p = cut(normalized(edges))
    z1 = cut(propagate(p, x))
    zero = F.lit(0.0)
    parts = x.select("node", F.coalesce("v", zero).alias("raw"), zero.alias("z1"), zero.alias("low"), F.lit(0).alias("own"))
    parts = parts.unionByName(z1.select("node", zero.alias("raw"), F.col("v").alias("z1"), zero.alias("low"), F.lit(0).alias("own")))
    d = p.join(z1.select(F.col("node").alias("dst"), "v"), "dst", "left")
    parts = parts.unionByName(d.select(F.col("src").alias("node"), zero.alias("raw"), zero.alias("z1"), (F.col("weight") * F.coalesce("v", zero)).alias("low"), F.lit(1).alias("own")))
    d = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("raw", "z1", "low")], F.max("own").alias("own")).where(F.col("own") == 1)
    return d.select("node", "raw", "low", (F.col("z1") - F.col("low")).alias("mid"), (F.col("raw") - F.col("z1")).alias("high"))


def _vector_sum(v: Column, weight: Column, dim: int) -> Column:
    """The weighted sum of arrays of ``dim`` numbers, added up place by place before the shuffle."""
    return F.array(*[F.sum(weight * v[i]) for i in range(dim)])


def vector_bands(edges: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """node, band (raw, low, mid, high), v: the bands of feature vectors (node, v of ``dim`` numbers); nodes without features count as zeros."""
    p = cut(normalized(edges))
    zeros = F.array_repeat(F.lit(0.0), dim)
    nodes = p.select(F.col("src").alias("node")).distinct()
    raw = cut(nodes.join(features.select("node", F.col("v").cast("array<double>").alias("v")), "node", "left").withColumn("v", F.coalesce("v", zeros)))

    def times(x: DataFrame) -> DataFrame:
        d = p.join(x.select(F.col("node").alias("dst"), "v"), "dst")
        return d.groupBy(F.col("src").alias("node")).agg(_vector_sum(F.col("v"), F.col("weight"), dim).alias("v"))

    z1 = cut(times(raw))
    d = raw.join(z1.withColumnRenamed("v", "z1"), "node").join(times(z1).withColumnRenamed("v", "low"), "node")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    each = F.array(*[F.struct(F.lit(k).alias("band"), v.alias("v")) for k, v in (("raw", F.col("v")), ("low", F.col("low")), ("mid", less("z1", "low")), ("high", less("v", "z1")))])
    return d.select("node", F.explode(each).alias("b")).select("node", "b.band", "b.v")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.greatest(F.sqrt(_dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(_dot(b, b)), F.lit(1e-12)))


def band_gate(seeds: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """query_id, band, v, gate: the bands pooled over a query's seeds, and the softmax of their cosines to the query.

    seeds: query_id, node, weight. nodes: from vector_bands. queries: query_id, v. A pooled band of zeros counts as a cosine of -1.
    """
    pooled = seeds.join(nodes, "node").groupBy("query_id", "band").agg(_vector_sum(F.col("v"), F.col("weight"), dim).alias("v"))
    d = pooled.join(queries.select("query_id", F.col("v").cast("array<double>").alias("q")), "query_id")
    d = d.withColumn("__c", F.when(F.sqrt(_dot(F.col("v"), F.col("v"))) <= 1e-12, -1.0).otherwise(cosine(F.col("v"), F.col("q"))))
    return d.withColumn("gate", F.exp("__c") / F.sum(F.exp("__c")).over(W.partitionBy("query_id"))).select("query_id", "band", "v", "gate")


def query_vectors(gates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, v: gate times part for raw, low, mid, high in turn; the raw part is the query itself."""
    d = gates.join(queries.select("query_id", F.col("v").cast("array<double>").alias("q")), "query_id")
    part = F.transform(F.when(F.col("band") == "raw", F.col("q")).otherwise(F.col("v")), lambda x: x * F.col("gate"))
    at = F.array_position(F.array(*map(F.lit, ("raw", "low", "mid", "high"))), F.col("band"))
    d = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("v")))).alias("x"))
    return d.select("query_id", F.flatten("x.v").alias("v"))


def hops(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """node, hops: the distance from the nearest seed, up to ``most``. Each step writes its new nodes only."""
    edges = cut(edges.select("src", "dst"))
    front = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    reached = front
    for k in range(1, most + 1):
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(reached, "node", "left_anti").withColumn("hops", F.lit(k)))
        reached = reached.unionByName(front)
    return reached


def seed_hops(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """seed, node, hops: the distance of every node from each seed on its own, up to ``most``. Each step writes its new pairs only."""
    edges = cut(edges.select("src", "dst"))
    front = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0)))
    reached = front
    for k in range(1, most + 1):
        new = edges.join(front.select("seed", F.col("node").alias("src")), "src").select("seed", F.col("dst").alias("node")).distinct()
        front = cut(new.join(reached, ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)))
        reached = reached.unionByName(front)
    return reached


def _walks(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, end, walk (array of nodes): all walks of at most two edges from the distinct nodes of ``starts`` (node)."""
    e = edges.select("src", "dst")
    w0 = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("walk"))
    step = lambda w: w.join(e, w["end"] == e["src"]).select("start", F.col("dst").alias("end"), F.concat("walk", F.array("dst")).alias("walk"))
    w1 = step(w0)
    return w0.unionByName(w1).unionByName(step(w1)).where(F.size(F.array_distinct("walk")) == F.size("walk"))


def rerank(hits: DataFrame, edges: DataFrame, bonus: float = 0.05) -> DataFrame:
    """query_id, object_id, score, rank: each hit gains ``bonus`` for every other hit of the query within four hops.

    hits: query_id, object_id, score; few per query. Two hits are within four hops if their neighbourhoods of two hops
    share a node, so the graph is walked two hops from the hits and no further. Ties go to the smaller id.
    """
    starts = hits.select(F.col("object_id").alias("node")).distinct()
    near = _walks(edges, starts).select("start", "end").distinct()
    own = hits.select("query_id", F.col("object_id").alias("start")).join(near, "start")
    a, b = own.select("query_id", F.col("start").alias("a"), "end"), own.select("query_id", F.col("start").alias("b"), "end")
    linked = a.join(b, ["query_id", "end"]).where(F.col("a") != F.col("b")).select("query_id", "a", "b").distinct()
    n = linked.groupBy("query_id", F.col("a").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    d = hits.join(n, ["query_id", "object_id"], "left").withColumn("score", F.col("score") + F.lit(bonus) * F.coalesce("n", F.lit(0))).drop("n")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "object_id")))


def best_path(hits: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """query_id, path (array of nodes): the shortest path of the first connected pair among a query's first hits.

    hits: query_id, object_id, rank. Pairs are tried by the first one's rank, then the other's; paths have four edges at most,
    and of equally short ones the least by its nodes is taken. Without a connected pair the path is the first hit alone.
    """
    top = hits.where(F.col("rank") <= most)
    w = _walks(edges, top.select(F.col("object_id").alias("node")).distinct())
    own = top.select("query_id", "rank", F.col("object_id").alias("start")).join(w, "start")
    a = own.select("query_id", F.col("rank").alias("i"), "end", F.col("walk").alias("x"))
    b = own.select("query_id", F.col("rank").alias("j"), "end", F.col("walk").alias("y"))
    d = a.join(b, ["query_id", "end"]).where(F.col("i") < F.col("j"))
    path = F.concat("x", F.slice(F.reverse("y"), 2, 2))
    d = d.groupBy("query_id").agg(F.min(F.struct("i", "j", F.size(path).alias("n"), path.alias("path"))).alias("m"))
    first = top.groupBy("query_id").agg(F.min(F.struct("rank", "object_id")).alias("f"))
    return first.join(d, "query_id", "left").select("query_id", F.coalesce("m.path", F.array("f.object_id")).alias("path"))
