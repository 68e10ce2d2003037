"""Means, intervals and tests of metric values by group, resampled where the rows lie.

values: the group columns, an id and a value, one row per id. A row's part in resample k depends on
the seed, its id and k alone, so each task adds up its own rows for all resamples and only sums are
shuffled: groups of any size, the same result on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
# The chances that a row is drawn at most 0, 1, 2, ... times (Poisson with mean 1).
_DRAWN = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.0030656620097620196, 0.0005109436682936699, 7.299195261338139e-05])


def _random(ids: np.ndarray, samples: int) -> np.ndarray:
    """Evenly spread 64-bit numbers, a row per id and a column per sample."""
    h = ids.view(np.uint64)[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _M3)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _resampled(values: DataFrame, group: list[str], tie: str, value: str, samples: int, seed: int, signs: bool) -> DataFrame:
    """group, sample, s, n: per resample the sum of the drawn values and their number (of the signed values, with ``signs``)."""
    schema = values.select(*group, F.lit(0).alias("sample"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, (s, n) in sums.items():
                cols = [pa.array([k] * samples, t) for k, t in zip(key, kinds)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(samples, dtype=np.int32)), pa.array(s), pa.array(n)], names=[*group, "sample", "s", "n"])

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [b.column(g).type for g in group]
            keys = list(zip(*(b.column(g).to_pylist() for g in group)))
            ids, v = b.column("__id").to_numpy(), b.column("__v").to_numpy()
            for key in set(keys):
                at = np.array([i for i, k in enumerate(keys) if k == key])
                s, n = sums.setdefault(key, [np.zeros(samples), np.zeros(samples, np.int64)])
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    r = _random(ids[part], samples)
                    times = (r >> np.uint64(63)).astype(np.int64) * 2 - 1 if signs else np.searchsorted(_DRAWN, r / 2.0**64)
                    s += v[part] @ times
                    n += len(part) if signs else times.sum(axis=0)
            if len(sums) > 1000:
                yield from out()
                sums.clear()
        yield from out()

    d = values.where(F.col(value).isNotNull()).select(*group, F.xxhash64(F.lit(seed), tie).alias("__id"), F.col(value).cast("double").alias("__v"))
    return d.mapInArrow(run, schema).groupBy(*group, "sample").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def summarize(values: DataFrame, group: list[str], tie: str, value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """group, n, mean, sd, ci95_low, ci95_high: bootstrap percentiles of the mean. Null values are left out; groups of nulls have n 0.

    Each resample draws every row a Poisson number of times, which for more than a few rows is the bootstrap's multinomial draw.
    """
    each = values.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    means = _resampled(values, group, tie, value, samples, seed, signs=False).where(F.col("n") > 0)
    p = F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975)))
    low = means.groupBy(*group).agg(p.alias("p")).select(*group, F.col("p")[0].alias("ci95_low"), F.col("p")[1].alias("ci95_high"))
    return each.join(low, group, "left")


def pair_differences(values: DataFrame, system: str, tie: str, value: str, by: list[str]) -> DataFrame:
    """by, system_a, system_b, tie, d: differences of every two systems on what all systems have a value for.

    values: by, system, tie, value, one row each.
    """
    v = values.where(F.col(value).isNotNull())
    all_of = v.groupBy(*by).agg(F.count_distinct(system).alias("__all"))
    whole = v.groupBy(*by, tie).agg(F.count_distinct(system).alias("__n")).join(all_of, by).where(F.col("__n") == F.col("__all")).select(*by, tie)
    v = v.join(whole, [*by, tie])
    a, b = v.select(*by, tie, F.col(system).alias("system_a"), F.col(value).alias("__a")), v.select(*by, tie, F.col(system).alias("system_b"), F.col(value).alias("__b"))
    d = a.join(b, [*by, tie]).where(F.col("system_a") < F.col("system_b"))
    return d.select(*by, "system_a", "system_b", tie, F.round(F.col("__a") - F.col("__b"), 9).alias("d"))


def cohens_d(d: str) -> Column:
    """Mean by deviation of the differences; 0 where all are 0, NaN where all are the same otherwise, null for fewer than two."""
    sd, mean = F.stddev_samp(d), F.avg(d)
    return F.when(F.count(d) < 2, F.lit(float("nan"))).when(sd > 0, mean / sd).otherwise(F.when(mean == 0, 0.0).otherwise(F.lit(float("nan"))))


def randomization_p(differences: DataFrame, group: list[str], tie: str, value: str = "d", permutations: int = 5000, seed: int = 42) -> DataFrame:
    """group, p: the share of sign flips whose mean is as far from 0 as the observed one, (e + 1) / (permutations + 1)."""
    seen = differences.groupBy(*group).agg(F.abs(F.sum(value)).alias("__seen"))
    flips = _resampled(differences, group, tie, value, permutations, seed, signs=True).join(seen, group)
    e = F.count_if(F.abs("s") >= F.col("__seen") - 1e-9)
    return flips.groupBy(*group).agg(((e + 1) / (F.lit(permutations) + 1)).alias("p"))


def hoeffding_p(n: Column, mean: Column) -> Column:
    """A bound of the p-value of a mean difference of values between 0 and 1, without resampling."""
    return F.least(F.lit(1.0), 2 * F.exp(-n * mean * mean / 2))


def holm(df: DataFrame, p: str, tie: str, out: str) -> DataFrame:
    """Holm's step-down adjustment of the p-values of one family of comparisons (a small table: pairs of systems times metrics)."""
    order = W.orderBy(p, tie)
    d = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy())).withColumn("__i", F.row_number().over(order) - 1)
    d = d.withColumn("__q", F.least(F.lit(1.0), (F.col("__n") - F.col("__i")) * F.col(p)))
    return d.withColumn(out, F.max("__q").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__n", "__i", "__q")


def collapse_runs(values: DataFrame, key: list[str], run: str, names: list[str], runs: int) -> DataFrame:
    """key, complete, and the mean of every named value over the runs; null unless all runs are there with a value."""
    complete = F.count_distinct(run) == runs
    means = [F.when(complete & (F.count(c) == F.count(F.lit(1))), F.avg(c)).alias(c) for c in names]
    return values.groupBy(*key).agg(complete.alias("complete"), *means)


def run_variation(values: DataFrame, group: list[str], run: str, value: str) -> DataFrame:
    """group, runs, mean, sd: of the means of the runs."""
    each = values.groupBy(*group, run).agg(F.avg(value).alias("__m")).where(F.col("__m").isNotNull())
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"))
