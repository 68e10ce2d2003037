"""Languages of texts: labels, character n-gram naive Bayes, and compression classification.

Both classifiers are fitted on a bounded sample of labelled rows (``labelled_sample``:
at most ``per_lang`` documents a language and ``chars`` characters of each, both documented
parameters). They are applied to whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import sentences

LANGS = "en de fr es pt it ru zh ja ar hi th".split()
# Two-letter code, three-letter codes and English name.
NOTATIONS = """
en eng english
de deu ger german
fr fra fre french
es spa spanish
pt por portuguese
it ita italian
ru rus russian
zh zho chi chinese
ja jpn japanese
ar ara arabic
hi hin hindi
th tha thai
"""


def label(c: Column) -> Column:
    """The two-letter code of a label in any notation (case, region, three letters, English name); else null."""
    known = {w: line.split()[0] for line in NOTATIONS.strip().splitlines() for w in line.split()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    base = F.regexp_extract(F.lower(c), r"^\s*([a-z]+)", 1)
    return F.try_element_at(table, base)


def labelled_sample(documents: DataFrame, per_lang: int = 400, chars: int = 3000) -> list[tuple[str, str]]:
    """(language by label, text) of at most per_lang documents a language, cut to ``chars`` characters.

    Rows are chosen by the hash of doc_id, so the same ones come out every time. Labels may be wrong.
    """
    d = documents.select("doc_id", F.col("text"), label(F.col("lang")).alias("l")).where(F.col("l").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.l: r.n for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # 12 rows
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("l") == lang) & (h < F.lit(int(min(1.0, 1.3 * per_lang / n) * 2**31))))
    rows = d.where(keep).select("l", F.substring("text", 1, chars).alias("t"), h.alias("h"), "doc_id").collect()
    out: list[tuple[str, str]] = []
    for lang in LANGS:
        own = sorted((r.h, r.doc_id, r.t) for r in rows if r.l == lang)[:per_lang]
        out += [(lang, t) for _, _, t in own]
    return out


class Bayes:
    """Naive Bayes over character 1- to 4-grams, hashed to a table of fixed size."""

    def __init__(self, size: int = 1 << 17):
        self.size = size
        self.log: np.ndarray | None = None

    def grams(self, text: str) -> np.ndarray:
        low = " " + " ".join(text.lower().split()) + " "
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out, h = [], np.zeros(len(c), np.uint64)
        for n in range(1, 5):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            if n > 1 or len(c) < 3:
                out.append((h >> np.uint64(40)) % np.uint64(self.size))
        return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)

    def fit(self, sample: list[tuple[str, str]]) -> Bayes:
        n = np.full((len(LANGS), self.size), 0.05)
        for lang, text in sample:
            np.add.at(n[LANGS.index(lang)], self.grams(text), 1.0)
        # a row per n-gram, so that a look-up reads one place
        self.log = np.ascontiguousarray(np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32))
        return self

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood per language, divided by 3 as neighbouring grams share their characters."""
        return self.log[self.grams(text)].sum(axis=0) / 3


class Compression:
    """The compressed size of a text with a zstandard raw-content dictionary per language."""

    LEVEL = 6

    def __init__(self, dictionaries: list[bytes]):
        self.raw, self._made = dictionaries, None

    def __getstate__(self):
        return self.raw

    def __setstate__(self, raw):
        self.raw, self._made = raw, None

    def sizes(self, text: str) -> np.ndarray:
        """Bytes per language; a language without a dictionary compresses without one."""
        return self.table([text])[0]

    def table(self, texts: list[str]) -> np.ndarray:
        """A row per text of the bytes per language."""
        return self.tables([(texts, range(len(LANGS)))])[0]

    def tables(self, documents: list[tuple[list[str], Iterable[int]]]) -> list[np.ndarray]:
        """Per document (texts, numbers of languages) a row per text of the bytes per language.

        Each dictionary takes all texts that ask for it in turn, so that it stays in the cache.
        A language that is not asked for counts as the text uncompressed.
        """
        if self._made is None:
            self._made = []
            for raw in self.raw:
                if len(raw) >= 64:
                    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    d.precompute_compress(level=self.LEVEL)
                    self._made.append(zstandard.ZstdCompressor(level=self.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
                else:
                    self._made.append(zstandard.ZstdCompressor(level=self.LEVEL, write_content_size=False))
        raw = [[t.lower().encode("utf-8", "replace") for t in texts] for texts, _ in documents]
        out = [np.array([16.0 + len(x) for x in own])[:, None].repeat(len(LANGS), axis=1) for own in raw]
        asked = [set(langs) for _, langs in documents]
        for g, z in enumerate(self._made):
            compress = z.compress
            for own, costs, langs in zip(raw, out, asked):
                if g in langs:
                    costs[:, g] = [len(compress(x)) for x in own]
        return out

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], size: int = 1 << 16) -> Compression:
        """Dictionaries of ``size`` bytes from the lines of the sample.

        The first ones hold every line of the label; the second ones leave out lines that
        the first compress better in another language, so that wrong labels drop out.
        """
        lines = [(lang, x) for lang, t in sample for x in t.split("\n") if sum(map(str.isalpha, x)) >= 12]

        def build(pairs: list[tuple[str, str]]) -> Compression:
            raw = []
            for lang in LANGS:
                b = "\n".join(dict.fromkeys(x.lower() for g, x in pairs if g == lang)).encode("utf-8", "replace")
                raw.append(b[-size:])
            return cls(raw)

        first = build(lines)
        # a line that lies in a dictionary word for word says nothing of its language: judge it without its own half
        half = build(lines[::2]), build(lines[1::2])
        kept = [(g, x) for i, (g, x) in enumerate(lines) if LANGS[int(np.argmin(half[1 - i % 2].sizes(x)))] == g]
        return build(kept) if kept else first


_LETTERS, _WIDE, _FINAL = re.compile(r"[^\W\d_]+"), re.compile("[⺁-\uffff]+"), re.compile("[.!?。！？।؟]")
_ENCLOSED = set("([{“„«「『（【\"'")
# The letters of each script, and the languages written in it.
_SCRIPTS = [
    (re.compile("[A-Za-z\u00c0-\u024f]"), 1, ("en", "de", "fr", "es", "pt", "it")),
    (re.compile("[\u0400-\u052f]"), 1, ("ru",)), (re.compile("[\u0600-\u06ff\u0750-\u077f\ufb50-\ufeff]"), 1, ("ar",)),
    (re.compile("[\u0900-\u097f]"), 1, ("hi",)), (re.compile("[\u0e00-\u0e7f]"), 1, ("th",)),
    (re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"), 3, ("zh", "ja")),
]


def written_in(text: str) -> frozenset[int]:
    """Numbers of the languages whose script has a fifth of the letters or more; all, if there is none."""
    if text.isascii():
        held = [(1, _SCRIPTS[0][2])] if any(map(str.isalpha, text)) else []
    else:
        held = [(n * weight, langs) for letters, weight, langs in _SCRIPTS if (n := len(letters.findall(text)))]
    total = sum(n for n, _ in held)
    return frozenset(LANGS.index(g) for n, langs in held if 5 * n >= total for g in langs) or frozenset(range(len(LANGS)))


def _cheapest(cost: np.ndarray, switch: float) -> list[int]:
    """The column of every row on the cheapest path, where every change of column costs ``switch``."""
    one = int(np.argmin(cost.sum(axis=0)))
    if (cost[:, one] == cost.min(axis=1)).all():  # best in every row: no path is cheaper
        return [one] * len(cost)
    path, back = cost[0].copy(), []
    for row in cost[1:]:
        best = int(np.argmin(path))
        moved = path[best] + switch
        back.append(np.where(path <= moved, np.arange(cost.shape[1]), best))
        path = np.minimum(path, moved) + row
    lang = [int(np.argmin(path))]
    for step in reversed(back):
        lang.append(int(step[lang[-1]]))
    return lang[::-1]


def _judged(text: str | None, spaces: dict | None) -> tuple[list[tuple[int, int, bool]], list[int], list[str]] | None:
    """(start, end, too weak to be judged) of the sentence units, the strong ones' numbers, and their texts."""
    parts = sentences.split(text, spaces)
    if not parts:
        return None
    units: list[tuple[int, int, bool]] = []
    for a, b in parts:
        s = text[a:b]
        letters = sum(map(len, _LETTERS.findall(s)))
        wide = 0 if s.isascii() else sum(map(len, _WIDE.findall(s)))
        aside = s[0] in _ENCLOSED and len(s) <= 60 and not _FINAL.search(s)
        units.append((a, b, letters + 3 * wide < 12 or aside or s[0] == "#"))
    strong = [i for i, u in enumerate(units) if not u[2]]
    if strong:
        return units, strong, [text[units[i][0] : units[i][1]] for i in strong]
    # headings alone may still be sentences of a language
    a, b = parts[0][0], parts[-1][1]
    return ([(a, b, False)], [0], [text[a:b]]) if sum(map(str.isalpha, text[a:b])) >= 12 else None


def segment(text: str | None, model: Compression, spaces: dict | None = None, switch: float = 7.0, least: float = 5.0) -> list[tuple[int, int, str, float]]:
    """(start, end, lang, confidence) of the segments of whole sentences in one language (see segments_of)."""
    return segments_of([text], model, spaces, switch, least)[0]


def segments_of(texts: list[str | None], model: Compression, spaces: dict | None = None, switch: float = 7.0, least: float = 5.0) -> list[list[tuple[int, int, str, float]]]:
    """Per text (start, end, lang, confidence) of the segments of whole sentences in one language.

    The languages of the sentence units are the cheapest path over their compressed sizes, where
    every change of language costs ``switch`` bytes: a change that saves less is rejected. A
    text is compressed for the languages in whose scripts some unit of it is written.
    Headings, units without a final mark in brackets or quotes, and units of few letters
    belong to what follows or precedes. A segment whose language is ahead by less than ``least``
    bytes is rejected: it joins its neighbour, and a text of such segments alone has none.
    Confidence is 1 - 2 ** (-lead in bytes / 8). Null and blank texts have no segments.
    """
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    judged = [(i, j) for i, t in enumerate(texts) if (j := _judged(t, spaces))]
    costs = model.tables([(own, frozenset().union(*map(written_in, own))) for _, (_, _, own) in judged])
    for (i, (units, strong, _)), cost in zip(judged, costs):
        out[i] = _segments(texts[i], units, strong, cost, switch, least)
    return out


def _segments(text: str, units: list[tuple[int, int, bool]], strong: list[int], cost: np.ndarray, switch: float, least: float) -> list[tuple[int, int, str, float]]:
    lang = _cheapest(cost, switch)
    runs: list[list] = []  # language, first and last strong unit, cost
    for k, g in enumerate(lang):
        if runs and runs[-1][0] == g:
            runs[-1][2], runs[-1][3] = k, runs[-1][3] + cost[k]
        else:
            runs.append([g, k, k, cost[k].copy()])
    out = []
    for g, first, last, total in runs:
        lead = float(np.min(np.delete(total, g)) - total[g])
        if lead < least:
            if out:
                out[-1][2] = last
            continue
        if out and out[-1][0] == g:
            out[-1][2], out[-1][3] = last, out[-1][3] + lead
        else:
            out.append([g, first, last, lead])
    # every unit goes to a segment: weak ones to the one that follows if they are headings
    spans = []
    for n, (g, first, last, lead) in enumerate(out):
        a = 0 if n == 0 else strong[first]
        while n and a > 0 and units[a - 1][2] and text[units[a - 1][0]] == "#":
            a -= 1
        spans.append([a, g, lead])
    result = []
    for n, (a, g, lead) in enumerate(spans):
        b = spans[n + 1][0] - 1 if n + 1 < len(spans) else len(units) - 1
        result.append((units[a][0], units[b][1], LANGS[g], 1.0 - 2.0 ** (-lead / 8)))
    return result


def segments(documents: DataFrame, model: Compression, spaces: dict) -> DataFrame:
    """doc_id, lang (as labelled), segment_no, start_char, end_char, language, confidence of all segments."""
    shared = documents.sparkSession.sparkContext.broadcast((model, spaces))
    d = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    schema = "doc_id bigint, lang string, segment_no int, start_char int, end_char int, language string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zs, spaced = shared.value
        names = ["doc_id", "lang", "segment_no", "start_char", "end_char", "language", "confidence"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        for b in batches:
            rows = []
            ids, labels, texts = (c.to_pylist() for c in b.columns)
            for i, old, found in zip(ids, labels, segments_of(texts, zs, spaced)):
                rows += [(i, old, no, *s) for no, s in enumerate(found, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    return d.mapInArrow(run, schema)


def doubtful(found: DataFrame) -> DataFrame:
    """The segments of documents whose label is missing or wrong, or that have several segments."""
    last = found.groupBy("doc_id").agg(F.max("segment_no").alias("__last"), F.min(F.when(F.col("segment_no") == 1, F.col("language"))).alias("__one"), F.first("lang").alias("__lang"))
    bad = last.where((F.col("__last") > 1) | ~label(F.col("__lang")).eqNullSafe(F.col("__one"))).select("doc_id")
    return found.join(bad, "doc_id", "left_semi")
