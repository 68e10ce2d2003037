"""Near-duplicate records by anchor-point covering.

A record is the multiset of its words. Records with the same multiset are one class; all
further work is on classes. A class has a pool of min-hashes: two classes of similarity J
agree in any one of them with probability J, and in one bit of it with (1 + J) / 2.

A fingerprint is a word of ``symbols`` whole min-hashes and 7 one-bit min-hashes. Anchors
are the words of a covering code of such words: every choice of symbols, with the 16 words
of the perfect Hamming code on the bits. The code's covering radius is 1 (a bit; the
symbols are met exactly). A fingerprint lives at its own anchor, the only one within 1, and
visits every anchor with its symbols within radius + threshold = 2: if two fingerprints with
equal symbols differ in at most THRESHOLD = 1 bit, the one visits the anchor where the
other lives, without exception. Classes are compared per anchor, first by two bits of 96
min-hashes, then exactly by the words themselves.

The anchor space grows with the data: a symbol more for each ten times as many records, so that
the classes one class is compared with stay about as many (see plan). Each class has several
independent fingerprints, as many as it takes for two classes of the least similarity
to meet with probability RECALL (see meets and recall).
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, RADIUS, THRESHOLD = 7, 1, 1
RECALL = 0.98  # of pairs exactly at the least similarity, before the check by CHECK
AT_ANCHOR = 1000  # records for which no symbol would be needed
CHECK = 37  # of 96 differing two-bit min-hashes; at J = 0.7 the mean is 21.6 and the deviation 4.1
STEP = 4096  # elements that are hashed at once
CHECKS = ("c0", "c1", "c2")
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


@functools.cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Per 7-bit word: its own anchor, and the anchors at distance 2 (padded with -1)."""
    syndrome = lambda w: functools.reduce(int.__xor__, (i + 1 for i in range(BITS) if w >> i & 1), 0)
    anchors = np.array([w for w in range(1 << BITS) if not syndrome(w)])
    far = np.bitwise_count(np.arange(1 << BITS)[:, None] ^ anchors)
    away = [anchors[f == RADIUS + THRESHOLD] for f in far]
    width = max(map(len, away))
    return anchors[far.argmin(axis=1)], np.array([[*a, *[-1] * (width - len(a))] for a in away])


@functools.cache
def meets(similarity: float) -> float:
    """The probability that the bits of one fingerprint meet at an anchor."""
    own, _ = _code()
    p, words = (1 - similarity) / 2, np.arange(1 << BITS)
    within = (np.bitwise_count(own[:, None] ^ words[:, None] ^ words) <= RADIUS + THRESHOLD).mean(axis=0)
    k = np.bitwise_count(words)
    return float((p**k * (1 - p) ** (BITS - k) * within).sum())


def recall(similarity: float, symbols: int, blocks: int) -> float:
    """The probability that two classes of this similarity meet in one of ``blocks`` fingerprints."""
    return 1 - (1 - similarity**symbols * meets(similarity)) ** blocks


def plan(records: int, least: float) -> tuple[int, int]:
    """(symbols, blocks) for so many records: unrelated texts agree in a symbol one time in ten or less."""
    symbols = max(1, round(math.log10(max(records, 1) / AT_ANCHOR)))
    return symbols, math.ceil(math.log(1 - RECALL) / math.log(1 - least**symbols * meets(least)))


_UNSPACED = "฀-๿㐀-䶿一-鿿豈-﫿぀-ヿ々ー"


# characters beyond Latin and Cyrillic letters and common marks: without any, the standard patterns are enough
_BEYOND = re.compile("[\u0300-\u03ff\u0483-\u0489\u0530-\u1fff\u2070-\U0010ffff]")
_PLAIN = re.compile(r"[^\W_]+")


@functools.cache
def _word_pattern():
    import regex

    return regex.compile(r"[\p{L}\p{M}\p{N}]+"), regex.compile(rf"[{_UNSPACED}]+")


def words(text: str) -> list[str]:
    """Runs of letters (with their combining signs) and digits, lower case.

    In unbroken runs of Thai, Chinese or Japanese script every three consecutive
    characters are a word; a shorter run is one word.
    """
    low = text.lower()
    if not _BEYOND.search(low):
        return _PLAIN.findall(low)
    run, unspaced = _word_pattern()
    out = []
    for w in run.findall(low):
        if w.isascii():
            out.append(w)
            continue
        at = 0
        for m in unspaced.finditer(w):
            if m.start() > at:
                out.append(w[at : m.start()])
            s = m.group()
            out += [s[i : i + 3] for i in range(max(1, len(s) - 2))]
            at = m.end()
        if at < len(w):
            out.append(w[at:])
    return out


def _elements(text: str) -> np.ndarray:
    """Sorted hashes of (word, how often before): the multiset as a set."""
    seen: dict[str, int] = {}
    out = []
    for w in words(text):
        k = seen[w] = seen.get(w, 0) + 1
        out.append(xxhash.xxh64_intdigest(w, k))
    return np.unique(np.array(out, np.uint64))


@functools.cache
def _pool(symbols: int, blocks: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of the pool's hash functions, and per fingerprint the ones that it uses."""
    size = max(96, blocks * (symbols + BITS))
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, size, dtype=np.uint64)
    return a, b, r.permutation(size)[: blocks * (symbols + BITS)].reshape(blocks, symbols + BITS)


def min_hashes(elements: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of min-hashes for each record; ``elements`` of all records in turn, none without any.

    They are folded STEP elements at a time, so that the longest text takes no more memory.
    """
    out = np.full((len(starts), len(a)), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(elements), STEP):
        h = elements[s : s + STEP, None] * a
        h += b
        h ^= h >> np.uint64(29)
        h *= _M1
        first, last = np.searchsorted(starts, [s, s + len(h) - 1], "right") - 1
        low = np.minimum.reduceat(h, np.maximum(starts[first : last + 1] - s, 0), axis=0)
        np.minimum(out[first : last + 1], low, out=out[first : last + 1])
    return out


def _bits(h: np.ndarray, n: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * _M2) >> np.uint64(64 - n)


def placed(hashes: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per record the keys of the anchors where it lives, those it visits besides, and whether each of these exists."""
    near, far = _code()
    own, away, there = [], [], []
    for k, use in enumerate(uses):
        h = np.full(len(hashes), k + 1, np.uint64) * _M3
        for i in use[:-BITS]:
            h = (h ^ hashes[:, i]) * _M1
            h ^= h >> np.uint64(31)
        p = (_bits(hashes[:, use[-BITS:]], 1) << np.arange(BITS, dtype=np.uint64)).sum(axis=1).astype(np.int64)
        key = lambda anchor, h=h: (h + (anchor + 1).astype(np.uint64)) * _M2
        own.append(key(near[p]))
        away += [key(x) for x in far[p].T]
        there += [x >= 0 for x in far[p].T]
    return tuple(np.stack(x, axis=1) for x in (own, away, there))


def classes(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: key, class_id, copy_id, elements. Null keys and records without words have none.

    class_id is a hash of the words, so equal multisets share it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_elements(t or "") for t in b.column(1).to_pylist()]
            keep = [i for i, e in enumerate(sets) if len(e)]
            ids = [xxhash.xxh3_64_intdigest(sets[i].tobytes()) - 2**63 for i in keep]
            ends = np.cumsum([0] + [len(sets[i]) for i in keep])
            values = np.concatenate([sets[i] for i in keep]).view(np.int64) if keep else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array(ids, pa.int64()), b.column(2).take(keep), lists], names=[key, "class_id", "copy_id", "elements"])

    kind = dict(records.dtypes)[key]
    d = records.where(F.col(key).isNotNull()).select(key, text, "copy_id")
    return d.mapInArrow(read, f"`{key}` {kind}, class_id bigint, copy_id bigint, elements array<bigint>")


def members_of(each: DataFrame, key: str) -> DataFrame:
    """key, class_id, copy_id of every record once; of rows with the same key the greatest counts."""
    one = each.groupBy(key).agg(F.max(F.struct("class_id", "copy_id")).alias("m"))
    return one.select(key, "m.class_id", "m.copy_id")


def anchored(found: DataFrame, symbols: int, blocks: int) -> DataFrame:
    """class_id, n (words), c0 to c2 (two bits of 96 min-hashes), own and away (keys of anchors) of every class."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, uses = _pool(symbols, blocks)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("elements")
            size = np.diff(lists.offsets.to_numpy())
            hashes = min_hashes(lists.flatten().to_numpy().view(np.uint64), np.cumsum(size) - size, a, b)
            own, away, there = placed(hashes, uses)
            check = (_bits(hashes[:, :96], 2).reshape(-1, 3, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2).view(np.int64)
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class_id"), pa.array(size.astype(np.int32)), *(pa.array(c) for c in check.T),
                    pa.ListArray.from_arrays(ends(np.full(len(own), own.shape[1])), pa.array(own.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(ends(there.sum(axis=1)), pa.array(away[there].view(np.int64))),
                ],
                names=["class_id", "n", *CHECKS, "own", "away"],
            )

    return found.mapInArrow(place, "class_id bigint, n int, c0 bigint, c1 bigint, c2 bigint, own array<bigint>, away array<bigint>")


def candidates(light: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) of classes a < b that meet at an anchor and pass the check of bits and sizes.

    The covering holds in either direction, so the class with the smaller id stays where it
    lives and only the other one visits. The join is a sort-merge join whatever the planner
    believes of the sizes; an anchor that many classes share is split by adaptive skew handling.
    """
    at = lambda c: light.select(F.explode(c).alias("anchor"), "class_id", "n", *CHECKS)
    x = at("own").alias("x")
    differ = [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in CHECKS]
    far = sum(F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555))) for d in differ)
    fits = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least)) & (far <= CHECK)
    met = []
    for c in ("own", "away"):
        y = at(c).alias("y")
        d = x.hint("merge").join(y, (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.class_id") < F.col("y.class_id")) & fits)
        met.append(d.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")))
    return met[0].unionByName(met[1]).distinct()


def class_pairs(found: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the candidates whose exact similarity is at least ``least``."""
    sets = found.select("class_id", "elements")
    d = met.join(sets.toDF("a", "ea").hint("merge"), "a").join(sets.toDF("b", "eb").hint("merge"), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    d = d.select("a", "b", (common / (F.size("ea") + F.size("eb") - common)).alias("similarity"))
    return d.where(F.col("similarity") >= least)


def member_pairs(members: DataFrame, pairs: DataFrame, key: str, block: int = 64) -> DataFrame:
    """(a, b) of member keys a < b: all pairs of members within and between similar classes.

    members: key, class_id, copy_id (members of equal copy_id are true copies). Only more than
    ``block`` true copies of one text are reduced: each is linked to the smallest key among
    them (see copies). Every pair of different texts is given, however large the classes. Pairs of
    texts are joined with their members, so that work grows with the pairs that come out.
    """
    texts = members.groupBy("class_id", "copy_id").agg(F.count(F.lit(1)).alias("k"), F.min(key).alias("first"))
    t = lambda c, t: texts.select(F.col("class_id").alias(c), F.col("copy_id").alias(t)).hint("merge")
    between = pairs.select("a", "b").join(t("a", "ta"), "a").join(t("b", "tb"), "b")
    within = t("a", "ta").join(t("b", "tb"), (F.col("a") == F.col("b")) & (F.col("ta") < F.col("tb")))
    same = texts.where(F.col("k").between(2, block)).select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("copy_id").alias("ta"), F.col("copy_id").alias("tb"))
    m = members.select("class_id", "copy_id", key)
    d = between.unionByName(within).unionByName(same).join(m.toDF("a", "ta", "p").hint("merge"), ["a", "ta"]).join(m.toDF("b", "tb", "q").hint("merge"), ["b", "tb"])
    one = (F.col("a") == F.col("b")) & (F.col("ta") == F.col("tb"))
    out = d.where(~one | (F.col("p") < F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    links = copies(members, key, block).where(F.col("copy_of") != F.col(key))
    return out.unionByName(links.select(F.col("copy_of").alias("a"), F.col(key).alias("b")))


def copies(members: DataFrame, key: str, more_than: int = 1) -> DataFrame:
    """key, copy_of: the smallest key with the same stored text, for texts that more than ``more_than`` keys share."""
    d = members.groupBy("class_id", "copy_id").agg(F.count(F.lit(1)).alias("k"), F.min(key).alias("copy_of")).where(F.col("k") > more_than)
    return members.join(d.hint("merge"), ["class_id", "copy_id"]).select(key, "copy_of")


def passage_text(passages: DataFrame) -> DataFrame:
    """passage_id, its title and sentences as one text (null parts are left out), and copy_id, a hash of both as stored."""
    parts = F.concat(F.array("title"), F.coalesce("sentences", F.array().cast("array<string>")))
    stored = F.to_json(F.struct("title", "sentences"))
    return passages.select("passage_id", F.array_join(parts, " ").alias("text"), F.xxhash64(stored).alias("copy_id"))
