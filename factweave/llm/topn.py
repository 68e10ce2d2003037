"""Top N items within every group, by secondary sort.

Rows are hash-partitioned by group, sorted within partitions by (group, order, item),
and read as a stream of Arrow batches that emits the first N distinct items of each
group. No group is held: the state is the current group's key and at most N items.

The same is done first within every input partition, before anything is shuffled: an item
among a group's first N is, where its best row lies, among the first N of that partition. So
what a group sends is at most N rows from each input partition, however many rows it has, and no
group, not even one with a third of all rows, is heavy in any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(group: list[str], item: str, n: int, out: list[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(g) for g in group]
            # a row starts a run where any group column differs from the row before
            change = None
            for k in keys:
                a, b = k.slice(1), k.slice(0, len(k) - 1)
                d = pa.compute.if_else(
                    pa.compute.and_(a.is_valid(), b.is_valid()),
                    pa.compute.fill_null(pa.compute.not_equal(a, b), False),
                    pa.compute.xor(a.is_valid(), b.is_valid()),
                )
                change = d if change is None else pa.compute.or_(change, d)
            starts = [0, *(i + 1 for i in pa.compute.indices_nonzero(change).to_pylist())]
            heads = [k.take(pa.array(starts)).to_pylist() for k in keys]
            items = batch.column(item)
            keep: list[int] = []
            for j, s in enumerate(starts):
                end = starts[j + 1] if j + 1 < len(starts) else batch.num_rows
                key = tuple(h[j] for h in heads)
                if key != last:
                    last, seen = key, set()
                i = s
                while i < end and len(seen) < n:
                    v = items[i].as_py()
                    if v not in seen:
                        seen.add(v)
                        keep.append(i)
                    i += 1
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in out], names=out)

    return emit


def top_n_per_group(df: DataFrame, group: list[str], order: list[str], item: str, n: int) -> DataFrame:
    """The first n distinct items of each group by the order columns ascending, then by item.

    Returns the group, order and item columns; others are dropped, so clashing names
    cannot arise. Ties in the order columns go to the smaller item. Repeated rows of an
    item count once, at the item's first place. Null groups form a group; rows with
    a null item or a null order column are left out. An empty input gives no rows.
    """
    cols = list(dict.fromkeys([*group, *order, item]))
    d = df.select(*cols).dropna(subset=[*order, item])
    first = _first_n(group, item, n, cols)
    d = d.sortWithinPartitions(*group, *order, item).mapInArrow(first, d.schema)
    return d.repartition(*group).sortWithinPartitions(*group, *order, item).mapInArrow(first, d.schema)


def best_facts(facts: DataFrame, n: int = 5) -> DataFrame:
    """The n best facts of each (query_id, source); null or NaN scores and null ids are left out."""
    score = F.col("score").cast("double")
    d = facts.where(score.isNotNull() & ~F.isnan(score) & F.col("query_id").isNotNull() & F.col("fact_id").isNotNull())
    d = d.select("query_id", "source", F.when(score == 0, 0.0).otherwise(-score).alias("__low"), F.col("fact_id").alias("item_id"))
    return top_n_per_group(d, ["query_id", "source"], ["__low"], "item_id", n)


def best_passages(results: DataFrame, n: int = 5) -> DataFrame:
    """The n passages of each example with the smallest position in any ranking.

    Ties go to the passage listed by more different systems (null is no system), then
    to the smaller id. Null, blank and ``__unmapped__:`` entries hold a position only.
    """
    at = results.select("example_id", "system", F.posexplode("document_ranking").alias("__pos", "item_id"))
    at = at.where(F.col("item_id").isNotNull() & F.col("item_id").rlike(r"\S") & ~F.col("item_id").startswith("__unmapped__:") & F.col("example_id").isNotNull())
    by_system = at.groupBy("example_id", "item_id", "system").agg(F.min("__pos").alias("__pos"))
    d = by_system.groupBy("example_id", "item_id").agg(F.min("__pos").cast("double").alias("__pos"), (-F.count("system")).alias("__few"))
    return top_n_per_group(d, ["example_id"], ["__pos", "__few"], "item_id", n)
