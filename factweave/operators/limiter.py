"""Rate limits over a trailing window, one row per request."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp, with or without time zone, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(column)


def trailing(requests: DataFrame, user: str, at: str, span: int, block: int = 3_600_000_000) -> DataFrame:
    """Adds ``trailing``: the user's requests of the last ``span`` microseconds, those at this very instant included.

    A user's time is cut into blocks, each of which also sees the ``span`` before it, so that no
    user, however busy, is one task.
    """
    own = F.floor(F.col(at) / block)
    seen = F.array_distinct(F.array(own, F.floor((F.col(at) + span - 1) / block)))
    d = requests.withColumn("__own", own).withColumn("__block", F.explode(seen))
    w = W.partitionBy(user, "__block").orderBy(at).rangeBetween(1 - span, 0)
    return d.withColumn("trailing", F.count(F.lit(1)).over(w)).where(F.col("__own") == F.col("__block")).drop("__own", "__block")


def admitted(requests: DataFrame, user: str, at: str, tie: str, limit: int, span: int) -> DataFrame:
    """Adds ``admitted``: whether fewer than ``limit`` admitted requests of the user lie in the ``span`` before.

    Greedy in the order of (at, tie), as a limiter decides it: a refused request takes no room.
    A user's requests stream through one task, which holds ``limit`` times at most.
    """
    fields = [x for x in requests.schema.simpleString().removeprefix("struct<").removesuffix(">").split(",")]
    schema = ", ".join("`{}` {}".format(*x.split(":", 1)) for x in fields) + ", admitted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, room = object(), deque()
        for b in batches:
            out = []
            for u, t in zip(b.column(user).to_pylist(), b.column(at).to_pylist()):
                if u != who:
                    who, room = u, deque()
                while room and t - room[0] >= span:
                    room.popleft()
                out.append(len(room) < limit)
                if out[-1]:
                    room.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "admitted"])

    return requests.repartition(user).sortWithinPartitions(user, at, tie).mapInArrow(run, schema)
