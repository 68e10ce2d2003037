"""Evaluation texts in training text, by SimHash of windows.

Every window of the items and of the documents gets a 64-bit SimHash. Fingerprints are cut
into radius + 1 blocks: two fingerprints within the radius agree in one block at least, so
joining windows on (block, bits of the block) finds all windows within the radius. What
is found is then verified exactly by the weighted similarity of the two windows' shingles.

Windows of RUN words (characters for Chinese items) find leaks of parts: where similarity is 1
the document holds the run. Windows of the size of an item, ITEM words, find edited leaks: one edit flips few
of their bits.

Documents are read where they lie. A bitmap of fixed size of the items' blocks goes to all tasks;
windows with none of their blocks in it can't meet an item's and stay where they are. Only the
others are joined. Weights of shingles are counted over all items before any search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import cut

RUN, ITEM = (12, 28), (60, 140)  # words, characters for Chinese items
SHINGLE = 5
FILTER = 1 << 26  # bits of the bitmap of blocks
BROADCAST_ROWS = 50_000  # of items' windows, some 250 bytes each
CHUNK = 100_000  # words whose fingerprints are made at once
_WORD = re.compile(r"[^\W_]+")
_HAN, _KANA = re.compile("[㐀-䶿一-鿿豈-﫿]"), re.compile("[ぁ-ヿ가-힯]")
_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh64_intdigest(word)
    return h


def units(text: str | None, chars: bool) -> np.ndarray:
    """Hashes of the words of a text, or of its letters and digits one by one."""
    found = _WORD.findall((text or "").casefold())
    if chars:
        found = list("".join(found))
    return np.fromiter(map(_hash, found), np.uint64, len(found))


def is_chinese(text: str | None) -> bool:
    """Whether an item counts as Chinese: it has Han characters, but no kana or hangul."""
    return bool(text) and bool(_HAN.search(text)) and not _KANA.search(text)


def simhash(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of every window of ``size`` words (none if there are fewer)."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = []
    for s in range(0, len(words) - size + 1, CHUNK):
        w = np.ascontiguousarray(words[s : s + CHUNK + size - 1])
        bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(w) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        out.append(np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1).view(np.uint64).ravel())
    return np.concatenate(out)


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words (none if there are fewer)."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def block_keys(prints: np.ndarray, radius: int, chars: bool) -> np.ndarray:
    """A row per block of the keys by which windows are joined: its number, its bits and the kind of window."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        bits = (prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)
        h = (bits + np.uint64((2 * k + chars + 1) << 52)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB))
    return np.stack(out)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _lists(a: np.ndarray) -> pa.Array:
    """A list array of the rows of a matrix of 8-byte numbers."""
    values = a.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(values.view(np.int64) if a.dtype == np.uint64 else values))


def weighted(items: DataFrame) -> DataFrame:
    """item_id, chars, words, shingles and their weights: 1 / (items that hold the shingle), counted over all items.

    Items without text have no row; of rows with the same id one counts.
    """
    one = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            chars = [is_chinese(t) for t in texts]
            found = [units(t, c) for t, c in zip(texts, chars)]
            lists = lambda x: pa.array([w.view(np.int64) for w in x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars), lists(found), lists([_rolled(w, SHINGLE) for w in found])], names=["item_id", "chars", "words", "shingles"])

    kind = dict(items.dtypes)["item_id"]
    d = cut(one.mapInArrow(read, f"item_id {kind}, chars boolean, words array<bigint>, shingles array<bigint>"))
    at = d.select("item_id", "chars", F.posexplode("shingles").alias("pos", "shingle"))
    weight = at.groupBy("chars", "shingle").agg((1.0 / F.count_distinct("item_id")).alias("w"))
    each = at.join(weight.hint("merge"), ["chars", "shingle"]).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("w"))
    return d.join(each.select("item_id", F.col("w.w").alias("weights")).hint("merge"), "item_id")


def item_windows(known: DataFrame, sizes: tuple[int, int], radius: int) -> DataFrame:
    """key, item_id, at, print, run (hash of the window), shingles, weights: a row per window and block of the items."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, chars, words, shingles, weights in zip(*(c.to_pylist() for c in b.columns)):
                size = sizes[chars]
                w, s, v = np.array(words, np.int64).view(np.uint64), np.array(shingles, np.int64), np.array(weights, np.float64)
                n = len(w) - size + 1
                if n < 1:
                    continue
                span = np.arange(n)[:, None] + np.arange(size - SHINGLE + 1)
                own, value = s[span], v[span]
                order = np.argsort(own, axis=1, kind="stable")
                again = np.take_along_axis(own, order, 1)
                again = np.concatenate([np.zeros((n, 1), bool), again[:, 1:] == again[:, :-1]], axis=1)
                np.put_along_axis(value, order, np.where(again, 0.0, np.take_along_axis(value, order, 1)), 1)  # a shingle counts once
                prints, run = simhash(w, size), _rolled(w, size)
                for key in block_keys(prints, radius, chars):
                    yield pa.RecordBatch.from_arrays(
                        [_signed(key), pa.array([i] * n, b.column("item_id").type), pa.array(np.arange(n)), _signed(prints), _signed(run), _lists(own), _lists(value)],
                        names=["key", "item_id", "at", "print", "run", "shingles", "weights"],
                    )

    kind = dict(known.dtypes)["item_id"]
    return known.select("item_id", "chars", "words", "shingles", "weights").mapInArrow(
        cut_up, f"key bigint, item_id {kind}, at bigint, print bigint, run bigint, shingles array<bigint>, weights array<double>"
    )


def bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each key modulo FILTER: at most FILTER / 64 numbers, however many windows there are."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER - 1))
    rows = windows.select(F.shiftright(bit, 6).alias("i"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER // 64, np.int64)
    out[rows["i"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def document_windows(documents: DataFrame, known: np.ndarray, sizes: tuple[int, int], radius: int) -> DataFrame:
    """key, doc_id, at, print, run, shingles: a row per window and block of the documents that is in the bitmap."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if not held.any():
            return
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                for chars in (False, True) if text and _HAN.search(text) else (False,) if text else ():
                    size = sizes[chars]
                    words = units(text, chars)
                    prints = simhash(words, size)
                    if not len(prints):
                        continue
                    keys = block_keys(prints, radius, chars)
                    bit = (keys & np.uint64(FILTER - 1)).astype(np.int64)
                    block, at = np.nonzero((held[bit >> 6] >> (bit & 63)) & 1)
                    if len(at):
                        own = _rolled(words, SHINGLE)[at[:, None] + np.arange(max(sizes) - SHINGLE + 1).clip(max=size - SHINGLE)]
                        parts.append((keys[block, at], np.full(len(at), i), at, prints[at], _rolled(words, size)[at], own))
            if parts:
                key, i, at, prints, run, own = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), b.column("doc_id").take(pa.array(i)), pa.array(at), _signed(prints), _signed(run), _lists(own)], names=["key", "doc_id", "at", "print", "run", "shingles"]
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(search, f"key bigint, doc_id {kind}, at bigint, print bigint, run bigint, shingles array<bigint>")


def find_leaks(documents: DataFrame, known: DataFrame, sizes: tuple[int, int] = RUN, radius: int = 1, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, windows, similarity, holds_run: documents with a window like one of an item.

    documents: doc_id, text. known: from ``weighted``. Of all windows within the radius, those whose
    weighted similarity is at least ``least`` count: the weight of the shingles that both
    windows hold against that of the item's window and 1 for each shingle that only the document's has.
    windows: how many of the item's windows; similarity: the greatest; holds_run: whether a window is the
    same word for word. Null, blank and short texts match nothing; repeated rows give one row.
    """
    x = cut(item_windows(known, sizes, radius))
    small = x.count() <= BROADCAST_ROWS
    d = document_windows(documents, bitmap(x), sizes, radius)
    x = x.toDF("key", "item_id", "of", "p", "r", "s", "w")
    d = d.join(F.broadcast(x) if small else x.hint("merge"), "key").where(F.bit_count(F.col("print").bitwiseXOR(F.col("p"))) <= radius)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    common = add(F.zip_with("s", "w", lambda s, w: F.when(F.array_contains("shingles", s), w).otherwise(0.0)))
    d = d.withColumn("similarity", common / (add(F.col("w")) + F.size(F.array_except("shingles", "s")))).where(F.col("similarity") > least - 1e-9)
    d = d.withColumn("same", F.col("run") == F.col("r"))
    return d.groupBy("doc_id", "item_id").agg(F.count_distinct("of").alias("windows"), F.max("similarity").alias("similarity"), F.max("same").alias("holds_run"))
