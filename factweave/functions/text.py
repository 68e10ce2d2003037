"""Column expressions on text, and the few Arrow functions that built-in ones cannot express."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType


def category_key(c: Column) -> Column:
    """One spelling for categories that differ in case, outer whitespace, or in blank, ``-`` and ``_``.

    Null and blank values give null.
    """
    bare = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(bare, r"[\s_-]+", "_"), F.lit(""))


def compact(c: Column) -> Column:
    """Runs of whitespace as one blank, none outside; null stays null."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """NFKC, casefolded, marks other than + and - as blanks, whitespace compacted; null stays null."""
    return names.map(lambda x: None if x is None else " ".join(re.sub(r"[^\w\s+-]", " ", unicodedata.normalize("NFKC", x).casefold()).split()))


def slug(c: Column, default: str) -> Column:
    """Lower case, everything but letters and digits as one ``_``, none outside; ``default`` where nothing is left or null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))


def safe_id(c: Column) -> Column:
    """Runs of characters that are not ASCII letters, digits, ``_``, ``.`` or ``-`` as ``_``; ``item`` where nothing is left or null."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_"), F.lit("")), F.lit("item"))


def confidence(c: Column) -> Column:
    """A number between 0 and 1 from text; 0.5 where it is none (NaN counts as none)."""
    n = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(n, F.lit(0.5))))


def short_id(prefix: str, c: Column, length: int = 16) -> Column:
    """``prefix_`` and the first hexadecimal digits of the SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(c), 1, length))


def unit_interval(c: Column) -> Column:
    """A place in [0, 1) from the first 64 bits of the SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def split_sentences(c: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and whitespace, or between line breaks, compacted; blank ones are left out."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


_W = r"[\p{L}\p{N}_]"
_CAPITAL = rf"[A-Z](?:[\p{{L}}\p{{N}}_'-]*{_W})?"
NAMES = rf"(?:^|[^\p{{L}}\p{{N}}_])({_CAPITAL}(?:\s+{_CAPITAL}){{0,4}})"
LONG_WORDS = rf"(?:^|[^\p{{L}}\p{{N}}_])([a-zA-Z][\p{{L}}\p{{N}}_'-]{{4,}}{_W})"


def concepts(sentence: Column, title: Column, most: int = 8) -> Column:
    """The title, runs of up to five capitalized words, and words of six characters or more: the first ``most`` that differ beyond case."""
    found = [F.regexp_extract_all(sentence, F.lit(p), 1) for p in (NAMES, LONG_WORDS)]
    each = F.filter(F.transform(F.concat(F.array(F.coalesce(title, F.lit(""))), *found), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(each, F.lower)
    return F.slice(F.filter(each, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def _fenced(text: str) -> str:
    m = re.match(r"\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", text, re.S)
    return m.group(1) if m else text


def json_object(text: str | None) -> str | None:
    """The JSON object that a text is, holds in a fence, or holds first among other words; null if there is none."""
    decoder = json.JSONDecoder()
    body = _fenced(text or "")
    at = body.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(body, at)[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            at = body.find("{", at + 1)
        except RecursionError:
            return None
    return None


@pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """See json_object; keys are sorted, without blanks."""
    return texts.map(json_object)


@pandas_udf(StringType())
def json_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys and without blanks; null where it is no JSON."""

    def digest(t: str | None) -> str | None:
        try:
            v = json.loads(t) if t is not None else None
        except (ValueError, RecursionError):
            return None
        return None if t is None else hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace")).hexdigest()

    return texts.map(digest)


@pandas_udf(ArrayType(IntegerType()))
def offsets(texts: pd.Series, parts: pd.Series) -> pd.Series:
    """Where a part occurs in a text, beyond case, without overlaps; empty for null or empty parts."""
    return pd.Series([[m.start() for m in re.finditer(re.escape(p), t, re.I)] if t and p else [] for t, p in zip(texts, parts)])


@pandas_udf(StringType())
def grounded(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """The stretch of a text that a quote is, word for word or with other whitespace; null if it holds none."""

    def find(t: str | None, q: str | None) -> str | None:
        if not t or not q or not q.strip():
            return None
        if q in t:
            return q
        m = re.search(r"\s+".join(map(re.escape, q.split())), t)
        return m.group() if m else None

    return pd.Series([find(t, q) for t, q in zip(texts, quotes)], dtype=object)


def entity_text(name: Column, description: Column) -> Column:
    """``name. description``, or what there is of it."""
    return F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(". "), F.coalesce(description, F.lit(""))))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def seconds(milliseconds: Column) -> Column:
    return milliseconds / 1000.0


def export_id(passage: Column, index: Column) -> Column:
    """The id of a passage's sentence in a suite."""
    return F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws(":", passage, index), 256), 1, 16))


def derived_seed(c: Column) -> Column:
    """The first 64 bits of the SHA-256 as a whole number (decimal digits; they may exceed a signed 64-bit integer)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10)


def without_labels(answer: Column, labels: Column) -> Column:
    """The answer with every ``[label]`` as a blank, longer labels first; null labels are left out."""
    each = F.array_sort(F.transform(F.array_distinct(F.array_compact(F.coalesce(labels, F.array().cast("array<string>")))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.aggregate(each, F.coalesce(answer, F.lit("")), lambda a, x: F.replace(a, F.concat(F.lit("["), x["x"], F.lit("]")), F.lit(" ")))


def qualifiers(v: Column) -> Column:
    """A VARIANT object as a map of text: keys as by slug, nulls kept, true and false, numbers and text that is not blank; the rest is left out."""
    held = F.map_filter(v.cast("map<string,variant>"), lambda k, x: F.coalesce(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)") & (F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")).rlike(r"\S")), F.lit(True)))
    each = F.transform(F.map_entries(held), lambda e: F.struct(slug(e["key"], "qualifier").alias("key"), F.trim(F.try_variant_get(e["value"], "$", "string")).alias("value")))
    return F.map_from_entries(each)


@pandas_udf(ArrayType(StringType()))
def cut_at_sentences(texts: pd.Series, most: pd.Series) -> pd.Series:
    """A text in parts of at most ``most`` characters, cut after the last line break or ``. `` that fits, else where the space ends."""

    def cut(t: str | None, n: int) -> list[str]:
        out, at = [], 0
        while t and at < len(t):
            end = min(len(t), at + n)
            if end < len(t):
                stop = max(t.rfind("\n", at, end), t.rfind(". ", at, end))
                end = stop + 1 if stop > at else end
            out.append(t[at:end])
            at = end
        return [x.strip() for x in out if x.strip()]

    return pd.Series([cut(t, n) for t, n in zip(texts, most)])


def answer_prompt(question: Column, context: Column) -> Column:
    """What a generator is asked: to answer from the evidence alone and cite it."""
    return F.concat(F.lit("Answer the question from the evidence below only, and cite the evidence you use as [fact_id].\n\nQuestion: "), question, F.lit("\n\nEvidence:\n"), F.coalesce(context, F.lit("")))
