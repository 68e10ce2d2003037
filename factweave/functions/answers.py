"""Answer normalization and overlap, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_tokens(c: Column) -> Column:
    """Tokens of an answer: citations, ASCII punctuation and English articles left out, lower case."""
    bare = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[fact_[^\]]*\]", " "))
    bare = F.regexp_replace(bare, r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))


def _count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def overlap(a: Column, b: Column) -> Column:
    """Tokens common to both, each as often as both hold it."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(_count(a, w), _count(b, w)))


def f1(a: Column, b: Column) -> Column:
    """Token F1; yes, no and noanswer match only as a whole; two empty answers agree."""
    closed = ["yes", "no", "noanswer"]
    one = lambda x: (F.size(x) == 1) & F.element_at(F.concat(x, F.array(F.lit(""))), 1).isin(closed)
    common = overlap(a, b)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
        .when((one(a) | one(b)) & (a != b), 0.0)
        .otherwise(2.0 * common / (F.size(a) + F.size(b)))
    )


def answer_scores(a: Column, references: Column) -> Column:
    """Struct of em, precision, recall, f1 against the best of several references: by f1, em, recall, precision.

    a: tokens of the answer; references: strings. No references count as one empty reference.
    """
    closed = ["yes", "no", "noanswer"]
    one = lambda x: (F.size(x) == 1) & F.element_at(F.concat(x, F.array(F.lit(""))), 1).isin(closed)

    def score(reference: Column) -> Column:
        b = answer_tokens(reference)
        common = overlap(a, b)
        equal, none = a == b, (F.size(a) == 0) | (F.size(b) == 0)
        zero = (none | one(a) | one(b)) & ~equal
        part = lambda x: F.when(equal, 1.0).when(zero, 0.0).otherwise(x)
        return F.struct(
            part(2.0 * common / (F.size(a) + F.size(b))).alias("f1"), equal.cast("double").alias("em"), part(common / F.size(b)).alias("recall"), part(common / F.size(a)).alias("precision")
        )

    some = F.when(F.size(references) > 0, references).otherwise(F.array(F.lit("")))
    return F.array_max(F.transform(some, score))


def citation_ids(c: Column) -> Column:
    """The distinct ``[fact_...]`` labels of a text in first-seen order; never null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x.startswith("fact_")))


def citation_status(status: Column, received: Column, valid: Column, unmapped: Column, has_gold: Column, parse_failed: Column) -> Column:
    """What became of a result's citations; received, valid, unmapped are counts."""
    return (
        F.when(~has_gold, "no_gold_evidence")
        .when(status == "missing", "result_missing")
        .when(status.isin("failed", "unscorable"), F.when(unmapped > 0, "citation_mapping_failed").otherwise("result_failed"))
        .when(parse_failed, "citation_parse_failed")
        .when(received == 0, "citation_empty")
        .when((unmapped > 0) & (valid == 0), "citation_invalid_id")
        .when(unmapped > 0, "citation_mapping_failed")
        .otherwise("success")
    )
