"""Running sums and ranks over groups of any size, without one task per group.

A window over a whole group would put the group into one task. Here each group is
cut into many buckets by the leading bits of the order key; bucket totals are summed
up first (a small table), and only rows of one bucket share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(seed: int, *cols: Column) -> Column:
    """A non-negative pseudo-random order key (63 bits) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def running_sum(df: DataFrame, group: list[str], key: str, tie: str, value: str, out: str, bits: int = 10) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows up to this one, by (key, tie).

    ``key`` must be a non-negative 63-bit integer spread evenly, as from shuffle_key.
    Null values count as 0; groups with null keys are groups of their own.
    """
    b, total, before = "__bucket", "__in_bucket", "__before"
    d = df.withColumn(b, F.shiftrightunsigned(F.col(key), 63 - bits))
    sums = d.groupBy(*group, b).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(total))
    over = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(b).alias("__b"),
        F.coalesce(F.sum(total).over(over), F.lit(0)).alias(before),
    )
    same = (F.col(b) == F.col("__b"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = W.partitionBy(*group, b).orderBy(key, tie).rowsBetween(W.unboundedPreceding, 0)
    return (
        d.join(offsets, same, "left")
        .withColumn(out, F.col(before) + F.sum(F.coalesce(F.col(value), F.lit(0))).over(inner))
        .drop(b, "__b", before, *[f"__g{i}" for i in range(len(group))])
    )
