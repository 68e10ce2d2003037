"""Fusing, cutting and scoring rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def top(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts every partition to k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def rrf(hits: DataFrame, constant: int = 60) -> DataFrame:
    """query_id, fact_id, score: sum over channels of 1 / (constant + best rank).

    A fact counts once a channel; null ids and null ranks are left out.
    """
    d = hits.dropna(subset=["query_id", "fact_id", "rank"])
    best = d.groupBy("query_id", "fact_id", "source").agg(F.min("rank").alias("rank"))
    # rounding makes the sum independent of its order
    return best.groupBy("query_id", "fact_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))


def distinct_ranking(ranking: Column) -> Column:
    """The passages of a ranking in first-seen order, without null and blank entries; never null."""
    return F.coalesce(F.array_distinct(F.filter(ranking, lambda x: x.isNotNull() & x.rlike(r"\S"))), F.array().cast("array<string>"))


def ranking_scores(df: DataFrame, ranking: str, gold: str) -> DataFrame:
    """Adds recall, precision, returned_precision, hit, complete and ndcg at 1, 3, 5, 10, 20, mrr_20 and mrr (the same).

    Repeated entries count once; gold is a set. returned_precision divides by the entries there are, at most k. All
    are null where gold is empty or null.
    """
    d = df.withColumn("__r", distinct_ranking(F.col(ranking))).withColumn("__g", F.array_distinct(F.array_compact(gold)))
    d = d.withColumn("__hits", F.transform("__r", lambda x: F.array_contains("__g", x).cast("int")))
    some = F.size("__g") > 0
    gain = F.transform("__hits", lambda h, i: h / F.log2(i + 2.0))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    first = F.nullif(F.array_position(F.slice("__hits", 1, KS[-1]), 1), F.lit(0))
    cols = {f"mrr_{KS[-1]}": F.when(some, F.coalesce(1.0 / first, F.lit(0.0)))}
    cols["mrr"] = cols[f"mrr_{KS[-1]}"]
    for k in KS:
        found = add(F.slice("__hits", 1, k))
        ideal = add(F.transform(F.sequence(F.lit(1), F.least(F.size("__g"), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0)))
        cols[f"recall_{k}"] = F.when(some, found / F.size("__g"))
        cols[f"precision_{k}"] = F.when(some, found / k)
        cols[f"returned_precision_{k}"] = F.when(some, F.coalesce(found / F.nullif(F.least(F.size("__r"), F.lit(k)), F.lit(0)), F.lit(0.0)))
        cols[f"hit_{k}"] = F.when(some, F.least(found, F.lit(1.0)))
        cols[f"complete_{k}"] = F.when(some, (found == F.size("__g")).cast("double"))
        cols[f"ndcg_{k}"] = F.when(some, F.round(add(F.slice(gain, 1, k)) / ideal, 9))
    return d.withColumns(cols).drop("__r", "__g", "__hits")


def set_scores(predicted: Column, gold: Column) -> Column:
    """Struct of em, precision, recall, f1 of two sets; all null where gold is empty or null. A null prediction is empty."""
    p, g = F.array_distinct(F.array_compact(F.coalesce(predicted, F.array().cast("array<string>")))), F.array_distinct(F.array_compact(gold))
    n = F.size(F.array_intersect(p, g))
    some = F.size(g) > 0
    half = F.size(p) + F.size(g)
    return F.struct(
        F.when(some, ((n == F.size(p)) & (n == F.size(g))).cast("double")).alias("em"),
        F.when(some, F.coalesce(n / F.nullif(F.size(p), F.lit(0)), F.lit(0.0))).alias("precision"),
        F.when(some, n / F.size(g)).alias("recall"), F.when(some, 2.0 * n / half).alias("f1"),
    )


def joint(answer: Column, support: Column) -> Column:
    """Struct of em, precision, recall, f1: the products of answer's and support's; all null where one is null."""
    p, r = answer["precision"] * support["precision"], answer["recall"] * support["recall"]
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when((p + r).isNotNull(), 0.0))
    return F.struct((answer["em"] * support["em"]).alias("em"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, constant: int = 60) -> DataFrame:
    """query_id, object_id, score of hits (query_id, object_id, rank, channel): sum of weight / (constant + rank).

    weights: of the channels, 1 each by default; channels not named in it are an error when they occur.
    """
    w = F.lit(1.0)
    if weights is not None:
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), "channel"), F.raise_error(F.concat(F.lit("unknown channel "), "channel")))
    return hits.groupBy("query_id", "object_id").agg(F.round(F.sum(w / (F.lit(constant) + F.col("rank"))), 9).alias("score"))


def best_facts(facts: DataFrame) -> DataFrame:
    """Of each (query_id, fact_id) the greatest score, and of equal ones the smallest rank."""
    best = facts.groupBy("query_id", "fact_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("query_id", "fact_id", "b.score", (-F.col("b.r")).alias("first_rank"))


def rank_facts(facts: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` facts of each query by score, then the rank they had, then id."""
    return top(best_facts(facts), ["query_id"], [F.col("score").desc(), F.col("first_rank"), F.col("fact_id")], limit)


def passages_of(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, passage_id, rank of ranked facts (query_id, fact_id, score, rank): by the best fact's score, its rank, then id.

    passages: fact_id, passage_id. Facts without a passage are left out.
    """
    d = facts.join(passages, "fact_id").groupBy("query_id", "passage_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("b"))
    order = W.partitionBy("query_id").orderBy(F.col("b.score").desc(), F.col("b.r").desc(), "passage_id")
    return d.select("query_id", "passage_id", "b.score", F.row_number().over(order).alias("rank"))


def rerank(facts: DataFrame, logit: Column) -> DataFrame:
    """Ranked facts (query_id, fact_id, rank) in the order of ``logit``, then of the rank they had, then of id."""
    d = facts.withColumn("score", logit.cast("double")).withColumnRenamed("rank", "first_rank")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "first_rank", "fact_id")
    return d.withColumn("rank", F.row_number().over(order))
