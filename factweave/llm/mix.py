"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a seeded random order; a document's virtual finish
time is the source's tokens up to and including it, divided by the source's weight
(weights sum to 1). Repeats follow as further rounds of the same order. Sorted by
virtual finish time, the sources are interleaved at their weights; the mix ends where
its tokens reach the budget. The sort is by ranges: the tokens of each range are summed, and
only the range that holds the end is counted row by row.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import category_key
from factweave.operators.scan import running_sum, shuffle_key
from factweave.session import cut


def vocabulary_path() -> str:
    """The byte-level BPE vocabulary of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(root / "byte_bpe_multi_50k.tiktoken")


_ENCODINGS: dict = {}


def _encoding(name: str, pattern: str, vocabulary: bytes):
    """The encoding of a vocabulary file, made once a worker."""
    if name not in _ENCODINGS:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def with_tokens(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``tokens``, the number of tokens of the whole text (0 for null).

    The vocabulary file (about a megabyte) is read here and sent to the tasks.
    """
    import public_tokenizers

    file = Path(path or vocabulary_path())
    pattern, shared = public_tokenizers.PATTERN, df.sparkSession.sparkContext.broadcast(file.read_bytes())
    name = f"{file.stem}-{file.stat().st_size}"
    schema = df.select(*keep, F.lit(0).cast("bigint").alias("tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, pattern, shared.value)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(count, schema)


def queue(sized: DataFrame, targets: DataFrame, seed: int = 29) -> DataFrame:
    """Virtual finish times: doc_id, source (as in targets), round (from 0), tokens, weight, finish.

    sized: doc_id, source_key, tokens. targets: source, source_key, weight (sum 1), max_repeats.
    Documents without tokens take no part. Ties in the order go to the smaller doc_id.
    """
    d = sized.where((F.col("tokens") > 0) & F.col("source_key").isNotNull()).join(targets, "source_key")
    d = d.withColumn("__key", shuffle_key(seed, F.col("doc_id")))
    d = running_sum(d, ["source"], "__key", "doc_id", "tokens", "__upto")
    own = sized.groupBy("source_key").agg(F.sum("tokens").alias("__own"))
    d = d.join(own, "source_key").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    return d.select("doc_id", "source", "round", "tokens", "weight", ((F.col("round") * F.col("__own") + F.col("__upto")) / F.col("weight")).alias("finish"))


def reached(queued: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """Per target source: weight, last (its last virtual finish time) and short.

    All sources together reach virtual time ``budget`` when each gets its share; a source
    whose queue ends before that falls short of its share. A source without documents ends at 0.
    """
    ends = queued.groupBy("source").agg(F.max("finish").alias("last"))
    last = F.coalesce("last", F.lit(0.0))
    return targets.join(ends, "source", "left").select("source", "weight", last.alias("last"), (last < F.lit(float(budget))).alias("short"))


def shares(sized: DataFrame, targets: DataFrame, budget: int, seed: int = 29) -> DataFrame:
    """The report per target source: weight, last and short as in ``reached``, tokens_used and share of the mix."""
    q = cut(queue(sized, targets, seed))
    used = truncate(q, budget).groupBy("source").agg(F.sum("tokens").alias("tokens_used"))
    used = F.coalesce("tokens_used", F.lit(0)), reached(q, targets, budget).join(used, "source", "left")
    return used[1].select("source", "weight", "last", "short", used[0].alias("tokens_used"), (used[0] / F.lit(float(max(budget, 1)))).alias("share"))


def truncate(queued: DataFrame, budget: int) -> DataFrame:
    """The rows of the queue by virtual finish time, up to ``budget`` tokens in all.

    Ties in time go by source, doc_id and round. The row that would cross the budget and all after it are left out.
    """
    order = ["finish", "source", "doc_id", "round"]
    ranged = queued.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    d = cut(ranged)  # written, so that the ranges are the same whenever they are read
    sums = sorted((r["__range"], r.n) for r in d.groupBy("__range").agg(F.sum("tokens").alias("n")).collect())  # a row per range
    before, edge = 0, -1
    for k, n in sums:
        if before + n > budget:
            edge = k
            break
        before += n
    if edge < 0:
        return d.drop("__range")
    names = queued.columns

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = before
        for b in batches:
            run = used + np.cumsum(b.column("tokens").to_numpy())
            n = int(np.searchsorted(run, budget, "right"))
            yield b.select(names).slice(0, n)
            if n < len(run):
                return
            used = int(run[-1]) if len(run) else used

    last = d.where(F.col("__range") == edge).sortWithinPartitions(*order).mapInArrow(upto, queued.schema)
    return d.where(F.col("__range") < edge).drop("__range").unionByName(last)


def target_table(mix_targets: DataFrame) -> DataFrame:
    """source, source_key, weight (divided by the sum), max_repeats (at least 1)."""
    t = mix_targets.where(F.col("target_weight") > 0)
    total = t.agg(F.sum("target_weight")).first()[0] or 1.0
    return t.select(
        "source", category_key(F.col("source")).alias("source_key"), (F.col("target_weight") / F.lit(total)).alias("weight"), F.greatest(F.col("max_repeats"), F.lit(1)).alias("max_repeats")
    )
