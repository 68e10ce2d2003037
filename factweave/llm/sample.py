"""Samples that match target category shares.

Quota runs top-down over a category tree: field -> category -> leaf (the same records by another field:
the sources of a domain, the datasets of a query type). A category's quota is the larger of its minimum and its share of the
sample, rounded up, and is divided evenly among its leaves. What a leaf cannot fill passes
first to its siblings (the leaves of the same category), in proportion to what they have to
spare; what the category as a whole cannot fill is its unmet quota and passes to the
cousins (leaves of the field's other categories: first those with a target, then those without).
At a leaf, rows are drawn by the dense rank of a seeded permutation. Running sums over
siblings, cousins and rows are taken bucket by bucket (operators.scan), so that no field, category or leaf,
however large, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import category_key
from factweave.operators.scan import running_sum, shuffle_key


def _share_out(df: DataFrame, parent: list[str], weight: str, amount: str, out: str) -> DataFrame:
    """Divides the parent's ``amount`` in whole rows among its leaves in proportion to ``weight``.

    Parts are differences of rounded-down running shares, in a seeded order of the leaves: they sum to the amount, and none
    exceeds its weight while the amount does not exceed the weights' sum.
    """
    total = df.groupBy(*parent).agg(F.sum(weight).alias("__total"))
    d = df.withColumn("__key", shuffle_key(3, F.col("category"), F.col("leaf")))
    d = running_sum(d, parent, "__key", "leaf", weight, "__run").join(total, parent)
    upto = lambda x: F.floor(F.col(amount).cast("decimal(20,0)") * x / F.col("__total"))
    part = F.when(F.col("__total") > 0, upto(F.col("__run")) - upto(F.col("__run") - F.col(weight))).otherwise(0)
    return d.withColumn(out, part.cast("bigint")).drop("__key", "__run", "__total")


def needs(leaves: DataFrame, targets: DataFrame, pool: DataFrame, share: float = 0.2) -> DataFrame:
    """field_name, category, targeted, target_share, need, available, sample: a row per target or category found.

    leaves: field_name, category, leaf, n (rows). targets: field_name, category, target_share,
    min_rows. pool: field_name, pool (rows of the field's pool); the sample is ``share`` of it.
    """
    have = leaves.groupBy("field_name", "category").agg(F.sum("n").alias("available"))
    goal = targets.groupBy("field_name", "category").agg(F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    d = have.join(goal.withColumn("targeted", F.lit(True)), ["field_name", "category"], "full").join(pool, "field_name", "left")
    size = F.coalesce(F.col("pool"), F.lit(0)) * F.lit(share)
    # shares are decimals: round away the noise of doubles before rounding up
    return d.select(
        "field_name", "category", F.coalesce("targeted", F.lit(False)).alias("targeted"), "target_share",
        F.coalesce(F.greatest(F.col("min_rows"), F.ceil(F.round(F.col("target_share") * size, 6))), F.lit(0)).cast("bigint").alias("need"),
        F.coalesce("available", F.lit(0)).alias("available"), F.round(size).cast("bigint").alias("sample"),
    )


def fill(leaves: DataFrame, need: DataFrame) -> DataFrame:
    """Leaves with ``own``, what they give to their category's quota: their even part, and what siblings passed on."""
    d = leaves.where(F.col("category").isNotNull()).join(need, ["field_name", "category"]).withColumn("__one", F.lit(1))
    d = _share_out(d, ["field_name", "category"], "__one", "need", "__part").drop("__one")
    d = d.withColumn("__own", F.least("__part", "n")).withColumn("__spare", F.col("n") - F.col("__own"))
    short = d.groupBy("field_name", "category").agg(F.least(F.sum(F.col("__part") - F.col("__own")), F.sum("__spare")).alias("__pass"))
    d = _share_out(d.join(short, ["field_name", "category"]), ["field_name", "category"], "__spare", "__pass", "__more")
    return d.withColumn("own", F.col("__own") + F.col("__more")).drop("__part", "__own", "__spare", "__pass", "__more")


def unmet(need: DataFrame, filled: DataFrame) -> DataFrame:
    """The categories of ``needs`` with ``own`` (rows of their own leaves) and ``unmet`` (passed to cousins)."""
    own = filled.groupBy("field_name", "category").agg(F.sum("own").alias("own"))
    d = need.join(own, ["field_name", "category"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return d.withColumn("unmet", F.col("need") - F.col("own"))


def allocate(filled: DataFrame, categories: DataFrame) -> DataFrame:
    """Leaves with ``take``: ``own`` and what cousins passed on. ``categories``: from ``unmet``.

    What is missing is the unmet quota and what the shares leave of the sample, less what minimums take above the shares.
    """
    field = categories.groupBy("field_name").agg(F.sum("unmet").alias("u"), F.max("sample").alias("s"), F.sum("need").alias("q"), F.sum("own").alias("o"))
    zero = F.lit(0)
    missing = F.greatest(zero, F.least(F.col("u") + F.greatest(zero, F.col("s") - F.col("q")), F.col("s") - F.col("o")))
    d = filled.withColumn("__spare1", F.when(F.col("targeted"), F.col("n") - F.col("own")).otherwise(0))
    d = d.withColumn("__spare2", F.col("n") - F.col("own") - F.col("__spare1"))
    most = d.groupBy("field_name").agg(F.sum("__spare1").alias("m1"), F.sum("__spare2").alias("m2")).join(field, "field_name")
    most = most.withColumn("__first", F.least(missing, "m1")).withColumn("__second", F.least(missing - F.col("__first"), "m2"))
    d = d.join(most.select("field_name", "__first", "__second"), "field_name")
    d = _share_out(_share_out(d, ["field_name"], "__spare1", "__first", "__p1"), ["field_name"], "__spare2", "__second", "__p2")
    return d.select("field_name", "category", "leaf", "n", "own", (F.col("own") + F.col("__p1") + F.col("__p2")).alias("take"))


def report(categories: DataFrame, parts: DataFrame) -> DataFrame:
    """A row per target or category found: need, available, own, passed (taken over from cousins), quota, unmet."""
    quota = parts.groupBy("field_name", "category").agg(F.sum("take").alias("quota"))
    d = categories.join(quota, ["field_name", "category"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    return d.select("field_name", "category", "targeted", "target_share", "need", "available", "own", (F.col("quota") - F.col("own")).alias("passed"), "quota", "unmet")


def draw(records: DataFrame, parts: DataFrame, seed: int = 17) -> DataFrame:
    """The sample: record_id, field_name, category, leaf of the drawn rows.

    Of each leaf, the ``take`` rows with the smallest permuted dense rank are drawn. Record ids
    must be unique within a field (repeats are removed beforehand).
    """
    d = records.where(F.col("category").isNotNull()).withColumn("__key", shuffle_key(seed, F.col("field_name"), F.col("record_id")))
    d = running_sum(d.withColumn("__one", F.lit(1)), ["field_name", "category", "leaf"], "__key", "record_id", "__one", "__rank")
    return d.join(parts.select("field_name", "category", "leaf", "take"), ["field_name", "category", "leaf"]).where(F.col("__rank") <= F.col("take")).select(
        "field_name", "category", "leaf", "record_id"
    )


def records_of(df: DataFrame, key: str, field: str, column: Column, leaf: Column) -> DataFrame:
    """field_name, record_id, category, leaf; a record (same key) counts once, null keys not at all.

    Of repeated rows with different categories the smallest is taken. Blank categories are
    null; a null leaf is the leaf ``-``.
    """
    d = df.select(F.col(key).cast("string").alias("record_id"), F.struct(category_key(column).alias("category"), F.coalesce(category_key(leaf), F.lit("-")).alias("leaf")).alias("c"))
    d = d.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min("c").alias("c"))
    return d.select(F.lit(field).alias("field_name"), "record_id", "c.category", "c.leaf")
