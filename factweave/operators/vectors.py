"""Exact cosine search of a set of query vectors, in blocks, against all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.ranking import top
from factweave.session import cut


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 20_000) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of each query, itself left out.

    vectors: vec_id, embedding. queries: query_id, embedding. Queries go to the tasks in blocks of about ``block`` vectors, each
    with one pass over the vectors; with several blocks each block's result is written before the next is read, so that one block
    is on the driver at a time. A task sends k rows a query and batch at most. Norms have a floor of 1e-12; null vectors are left out; ties go to the smaller id.
    """
    q = queries.where(F.col("embedding").isNotNull())
    blocks = max(1, math.ceil(q.count() / block))
    parts = []
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about ``block`` rows
        if rows:
            d, shared = _block(vectors, rows, k)
            d = top(d, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
            if blocks > 1:
                d = cut(d)
                shared.destroy()
            parts.append(d)
    if not parts:
        return vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _block(vectors: DataFrame, rows: list, k: int) -> tuple[DataFrame, Broadcast]:
    ids = np.array([r.query_id for r in rows], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r.embedding for r in rows], np.float64))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, asked = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("vec_id").to_numpy()
            m = _unit(b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            for s in range(0, len(who), 1024):
                # rounded first, so that equal scores are ties everywhere
                score = np.round(asked[s : s + 1024] @ m.T, 6)
                score[who[s : s + 1024, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                r, c = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(who[s + r]), pa.array(keys[order[r, c]]), pa.array(best[r, c])], names=["query_id", "vec_id", "score"])

    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").mapInArrow(search, "query_id bigint, vec_id bigint, score double"), shared
