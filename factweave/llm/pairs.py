"""Broken prompt and response pairs.

A pair gets at most one defect, in this order: ``empty``, ``echo``, ``refusal``,
``language``, ``truncated``. Languages are compared by the posteriors of a naive Bayes over
character n-grams. Truncation is judged by the likelihood that a text ends where the
answer does: given its last one to four words, and, of a rare last word, given its letters. Both are counted over all
answers: contexts by their 64-bit hash (words rare in all answers by their shape, so names are
alike; inside an open bracket or a broken JSON string apart), words with all that begin like them.

The ends that are counted are those before a final mark. A text's end without one tells whether its beginning, or a
text in Thai, which has no marks, can end there; elsewhere it is what is to be judged, and counts for nothing.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.language import LANGS, Bayes
from factweave.session import cut

LETTERS = 40  # a longer word tells nothing by its letters
_WORD = regex.compile(
    r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+|\p{N}+(?:[.,:/-]\p{N}+)*|[^\s\p{L}\p{M}\p{N}]"
)
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_LABEL = re.compile(r"\[[^\[\]]*\]")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*(?:```\s*)?$", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_VALUE = re.compile(r'"(?:answer|response|text|output|content|result)"\s*:\s*"((?:[^"\\]|\\.)*)("?)', re.S)
_STOP = ".!?。！？।؟…॥．"
_QUOTES = "\"'”’»“」』*_`› \t\n"
_CLOSING = "\"'”’»“)]}」』）】*_`› \t\n"

# What stands in for an answer.
PLACEHOLDERS = frozenset("n/a na none null nil nan tbd todo tba undefined unknown placeholder empty answer response xxx no_answer noanswer".split())
# Words before a repeated question, or before the answer that is missing.
RELABELS = frozenset(
    """q a question answer you asked the your is was prompt query frage antwort f pregunta respuesta p r réponse pergunta resposta domanda risposta d
    вопрос ответ в о 问题 回答 问 答 質問 問 سؤال السؤال جواب الجواب प्रश्न उत्तर คำถาม คำตอบ""".split()
)
# Phrases that decline or say that an answer cannot be given.
REFUSALS = [
    r"\bi(?:'m| am) sorry\b", r"\bi (?:cannot|can't|can not|won't|will not|must decline|am not able to|am unable to|don't know|do not know|refuse to)\b", r"\bi'm (?:not able|unable)\b",
    r"\bno answer can be given\b", r"\b(?:passages|context|evidence|documents|sources|material|text)\b[^.!?]{0,30}\b(?:do|does) not (?:contain|provide|say|give|include|mention enough)\b",
    r"\b(?:not|n't) (?:contain |have |provide )?enough (?:information|evidence|context)\b", r"\bnothing in the (?:context|passages|evidence|material)\b", r"\bbeyond what i am\b",
    r"\b(?:it )?would not be appropriate for me\b", r"\bevidence doesn't say\b",
    r"\bich kann (?:diese|die|das|ihnen|hierzu|dazu)[^.!?]{0,40}nicht\b", r"reichen für eine antwort nicht", r"\b(?:tut mir|es tut mir) leid\b", r"darf ich (?:mich )?[^.!?]{0,20}nicht|\bich (?:darf|möchte|weiß)[^.!?]{0,40}nicht\b",
    r"\bje (?:suis désolé|ne peux pas|ne suis pas en mesure|ne sais pas|regrette)", r"ne (?:permettent|suffisent) pas (?:de|à|pour)[^.!?]{0,20}répon",
    r"\blo siento\b", r"\bno puedo (?:responder|contestar|ayudar|hablar|dar)", r"\bno me está permitido\b", r"\bpasajes no bastan\b", r"\bno (?:lo )?sé\b",
    r"\bnão posso (?:responder|ajudar|falar|dar|comentar)", r"\bpassagens não chegam\b", r"\bnão me é permitido\b|\bnão estou autorizad", r"\bnão sei\b", r"\b(?:lamento|desculpe|peço desculpa)\b",
    r"\bmi dispiace\b", r"\bnon posso (?:rispondere|aiutar|parlar|dare|commentare)", r"\bpassaggi non bastano\b", r"\bnon mi è (?:permesso|consentito)\b", r"\bnon lo so\b",
    r"\bизвините\b", r"\bне могу (?:ответить|помочь|об этом|говорить|комментировать|обсуждать)", r"недостаточно сведений", r"не имею права|мне не разрешено|\bя не знаю\b",
    r"无法(?:回答|作答|提供)", r"不足以(?:作答|回答)", r"我不能(?:就此|回答|讨论)", r"对不起|抱歉", r"お答えできません|答えられません|申し訳ありません|お話しできません|お話しすることはできません|コメントできません",
    r"لا أستطيع|لا يمكنني|لا تكفي لتقديم|عذرا|أعتذر|غير مسموح لي|لا يسمح لي", r"उत्तर नहीं दे सकत|क्षमा करें|उत्तर के लिए पर्याप्त नहीं|बात नहीं कर सकत|अनुमति नहीं है", r"ไม่สามารถตอบ|ขออภัย|ไม่เพียงพอ(?:ที่จะ|ต่อการ|สำหรับ)(?:การ|คำ)?ตอบ|ไม่ได้รับอนุญาต",
]
_LATIN = [x for x in REFUSALS if max(x) < "\u0300"]
_REFUSES, _REFUSES_ELSE = re.compile("|".join(_LATIN)), re.compile("|".join(x for x in REFUSALS if x not in _LATIN))
_NOT_LATIN = re.compile("[\u0370-\u1fff\u3040-\uffff]")
# Stems of names of languages, by which a question asks for one.
ASKED = {
    "en": "english englis anglais inglés ingles inglês английск 英语 英文 英語 إنجليزي अंग्रेज़ी अंग्रेजी อังกฤษ", "de": "german deutsch allemand alemán alemã alemão tedesc немецк 德语 德文 ドイツ語 ألماني जर्मन เยอรมัน",
    "fr": "french französisch français francés francesa francês frances французск 法语 法文 フランス語 فرنسي फ़्रेंच फ्रेंच ฝรั่งเศส", "es": "spanish spanisch espagnol español spagnol espanhol испанск 西班牙 スペイン語 إسباني स्पेनिश สเปน",
    "pt": "portugu portogh португальск 葡萄牙 ポルトガル برتغالي पुर्तगाली โปรตุเกส", "it": "italian italien italiano итальянск 意大利 イタリア إيطالي इतालवी อิตาลี", "ru": "russian russisch russe ruso russo русск 俄语 俄文 ロシア語 روسي रूसी รัสเซีย",
    "zh": "chinese chinesisch chinois chino chinês cinese китайск 中文 汉语 中国語 صيني चीनी จีน", "ja": "japanese japanisch japonais japonés japonês giapponese японск 日语 日文 日本語 ياباني जापानी ญี่ปุ่น",
    "ar": "arabic arabisch arabe árabe arabo арабск 阿拉伯 アラビア عربي अरबी อาหรับ", "hi": "hindi хинди 印地 ヒンディー هندي हिंदी हिन्दी ฮินดี", "th": "thai thaï tailand тайск 泰语 泰文 タイ語 تايلاند थाई ไทย",
}


def unwrap(response: str | None) -> tuple[str, bool]:
    """The answer inside fences or JSON, and whether the JSON breaks off."""
    t = response or ""
    m = _FENCE.match(t)
    if m:
        t = m.group(1)
    s = t.strip()
    if s[:1] in "{[\"" and s:
        try:
            v = json.loads(s)
        except ValueError:
            m = _VALUE.search(s) if s[0] == "{" else None
            return (m.group(1).replace("\\n", "\n").replace('\\"', '"'), not m.group(2)) if m else (t, False)
        if isinstance(v, dict):
            named = [v[k] for k in ("answer", "response", "text", "output", "content", "result") if k in v]
            v = named[0] if named else next((x for x in v.values() if isinstance(x, str)), "")
        if isinstance(v, list):
            v = " ".join(map(str, v))
        return ("" if v is None else str(v)), False
    return t, False


def bare(answer: str) -> str:
    """Without citation labels, tags and outer whitespace."""
    return _LABEL.sub(" ", _TAG.sub(" ", answer)).strip()


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def _shape(tokens: list[str], common: frozenset[str]) -> list[str]:
    out = []
    for w in tokens:
        c = w[0]
        if c.isdigit():
            out.append("0")
        elif not c.isalpha() or w.lower() in common:
            out.append(w.lower())
        else:
            out.append("A" if c.isupper() else "a")
    return out


@functools.lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


_OPENS, _CLOSES = frozenset("([{（【"), frozenset(")]}）】")


def _is_open(tokens: list[str], broken: bool = False) -> bool:
    """Whether a text ends inside a bracket or a broken JSON string."""
    depth = 0
    for t in tokens:
        depth = depth + 1 if t in _OPENS else max(0, depth - 1) if t in _CLOSES else depth
    return broken or depth > 0


def _context_hashes(words: list[str], hashes: list[int], i: int, inside: bool = False) -> list[tuple[int, bool]]:
    """64-bit hashes of the contexts that end with word i: none of the words, 1 to 4, or 2 to 9 characters of scripts without blanks.

    A context that reaches beyond the first word counts apart: it holds the text's beginning. So does one ``inside`` a bracket.
    With each: whether the text's own end is counted in it.
    """
    out, h = [], 0
    sizes = (0, 2, 4, 6, 9) if _UNSPACED.match(words[i]) else (0, 1, 2, 3, 4)
    for n in range(min(sizes[-1], i + 2) + 1):
        if n:
            h = (h * 0x9E3779B97F4A7C15 + (hashes[i - n + 1] if n <= i + 1 else 1)) & 0xFFFFFFFFFFFFFFFF
        if n in sizes:
            out.append(((h ^ (2 * n + inside + 1) * 0x2545F491) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF, n == i + 2 or "\u0e00" <= words[i][0] < "\u0e80"))
    return out


class _Shapes(dict):
    """Token -> number of its shape, made on first sight; 0 is the beginning of a text."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common, self.number = common, {}
        self.hashes, self.stops, self.unspaced, self.turns, self.thai = [1], [False], [False], [0], [False]

    def __missing__(self, token: str) -> int:
        (w,) = _shape([token], self.common)
        if w not in self.number:
            self.number[w] = len(self.hashes)
            self.hashes.append(_word_hash(w))
            self.stops.append(w[0] in _STOP)
            self.unspaced.append(bool(_UNSPACED.match(w)))
            self.thai.append("\u0e00" <= w[0] < "\u0e80")
            self.turns.append((w in _OPENS) - (w in _CLOSES))
        if len(self) > 1 << 18:
            self.clear()
        self[token] = k = self.number[w]
        return k


def _ended(numbers: np.ndarray, known: _Shapes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, whether a sentence ends there) of the contexts (as in _context_hashes) of all words of texts, each headed by 0."""
    at = np.arange(len(numbers))
    begins, stops, unspaced = numbers == 0, np.array(known.stops)[numbers], np.array(known.unspaced)[numbers]
    head = np.maximum.accumulate(np.where(begins, at, 0))
    depth, marked, ends = at - head, np.append(stops[1:], False), np.append(begins[1:], True)
    thai = np.array(known.thai)[numbers]
    inside = np.zeros(len(numbers), np.uint64)
    turns = np.array(known.turns)[numbers]
    for i in np.unique(head[turns != 0]).tolist():  # few texts have brackets
        end, level = i + 1, 0
        while end < len(numbers) and numbers[end]:
            level = max(0, level + int(turns[end]))
            inside[end] = level > 0
            end += 1
    values = np.array(known.hashes, np.uint64)[numbers]
    h = np.zeros(len(numbers), np.uint64)
    for n in range(min(9, len(numbers)) + 1):
        if n:
            h[n - 1 :] = h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + values[: len(numbers) - n + 1]
        if n not in (0, 1, 2, 3, 4, 6, 9):
            continue
        known_end = (depth + 1 == n) | thai
        of = ~begins & ~stops & (depth + 1 >= n) & (known_end | ~ends)
        if n not in (0, 2, 4):
            of &= unspaced if n > 4 else ~unspaced
        kind = (np.uint64(2 * n + 1) + inside[of]) * np.uint64(0x2545F491)
        yield (h[of] ^ kind) * np.uint64(0xBF58476D1CE4E5B9), (marked | ends)[of]


def _context_counts(numbers: np.ndarray, known: _Shapes) -> pa.RecordBatch:
    """context, e, n: each context of the texts once, with its ends and all its occurrences."""
    found = list(_ended(numbers, known))
    h, last = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, bool))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    e = np.add.reduceat(last[order].astype(np.int64), first) if len(h) else first
    n = np.diff(np.append(first, len(h)))
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(e), pa.array(n)], names=["context", "e", "n"])


def pairs_of(results: DataFrame, examples: DataFrame, responses: DataFrame) -> DataFrame:
    """kind, record_id, question, answer; a record (same key) counts once, null keys not at all."""
    q = examples.where(F.col("example_id").isNotNull()).groupBy("example_id").agg(F.max("question").alias("question"))
    r = results.where(F.col("result_id").isNotNull()).dropDuplicates(["result_id"]).select("result_id", "example_id", "answer")
    a = r.join(q, "example_id", "left").select(F.lit("result").alias("kind"), F.col("result_id").cast("string").alias("record_id"), "question", "answer")
    b = responses.where(F.col("cache_key").isNotNull()).dropDuplicates(["cache_key"])
    content = F.get_json_object("request", "$.messages[0].content")
    return a.unionByName(b.select(F.lit("response").alias("kind"), F.col("cache_key").alias("record_id"), content.alias("question"), F.col("response").alias("answer")))


def word_counts(each: DataFrame) -> DataFrame:
    """word, n: the words of the answers in lower case, and how many answers hold them."""

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in {w.lower() for w in _tokens(bare(unwrap(t)[0])) if w[0].isalpha()}:
                    n[w] = n.get(w, 0) + 1
            if len(n) > 500_000:
                yield out()
                n.clear()
        yield out()

    answers = each.where(F.col("answer").isNotNull()).select("answer")
    return answers.mapInArrow(holding, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(words: DataFrame, answers: int, rare: float = 0.0005) -> frozenset[str]:
    """The words that more than the share ``rare`` of the answers hold (and 8 at least): no more than the mean of different words an answer, divided by ``rare``."""
    return frozenset(r.word for r in words.where(F.col("n") > max(8, rare * answers)).select("word").collect())


def word_ends(words: DataFrame) -> DataFrame:
    """word, ends, begins: how many answers hold the word, and how many hold a word that begins with it (itself included)."""
    d = words.where(F.length("word") <= LETTERS)
    starts = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("word"), "n")
    begins = starts.groupBy("word").agg(F.sum("n").alias("begins"))
    return d.join(begins.hint("merge"), "word").select("word", F.col("n").alias("ends"), "begins")


def end_counts(each: DataFrame, common: frozenset[str]) -> DataFrame:
    """context, e, n: ends after the context, and all its occurrences, over all answers."""
    shared = each.sparkSession.sparkContext.broadcast(common)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = _Shapes(shared.value), []
        for b in batches:
            for t in b.column(0).to_pylist():
                numbers.append(0)
                numbers += map(known.__getitem__, _tokens(bare(unwrap(t)[0]).rstrip(_QUOTES)))
                if len(numbers) > 1 << 19:
                    yield _context_counts(np.array(numbers, np.int64), known)
                    numbers = []
        yield _context_counts(np.array(numbers, np.int64), known)

    counts = each.where(F.col("answer").isNotNull()).select("answer").mapInArrow(ends, "context bigint, e bigint, n bigint")
    return counts.groupBy("context").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))


def end_likelihood(counts: Column) -> Column:
    """The probability that a text ends after its last words; the text's own end is not counted.

    counts: an array of (at, e, n, own) of the contexts at its end, shorter ones first.
    """
    less = lambda x, c: F.greatest(F.lit(0), x - c["own"].cast("int"))
    return F.aggregate(F.array_sort(counts), F.lit(0.5), lambda p, c: (less(c["e"], c) + 2 * p) / (less(c["n"], c) + 2))


_RUN, _LETTER_RUN = regex.compile(r"[\p{L}\p{M}\p{N}]+"), regex.compile(r"[\p{L}\p{M}]+")


def _echo(question: str, answer: str) -> bool:
    flat = lambda x: " ".join(_RUN.findall(x.casefold()))
    q, a = flat(question), flat(answer)
    if not q or q not in a:
        return False
    return all(w in RELABELS for w in a.replace(q, " ").split())


class _Asked:
    """A question's words and scores, kept for the answers that follow it."""

    def __init__(self, languages: Bayes):
        self.languages, self.question = languages, None

    def read(self, question: str) -> tuple[str, set[str], np.ndarray]:
        if question != self.question:
            low = question.lower()
            self.question, self.found = question, (low, set(_LETTER_RUN.findall(low)), self.languages.scores(question))
        return self.found


def _other_language(question: str, answer: str, asked: _Asked, common: frozenset[str], margin: float) -> bool:
    """Names tell no language: rare words in Latin script and words of the question are left out."""
    low, own, sq = asked.read(question)
    text = " ".join(w for w in _LETTER_RUN.findall(answer) if (v := w.lower()) not in own and (w[0] > "\u024f" or v in common))
    if sum(map(str.isalpha, text)) < 4 or (len(text.split()) < 2 and text[0] <= "\u024f"):
        return False
    sa = asked.languages.scores(text)
    q, a = int(np.argmax(sq)), int(np.argmax(sa))
    if q == a or sa[a] - sa[q] < margin or sq[q] - sq[a] < margin:
        return False
    return not any(stem in low for stem in ASKED[LANGS[a]].split())


def defect(question: str | None, answer: str | None, asked: _Asked, common: frozenset[str], margin: float = 4.0) -> tuple[str | None, list[tuple[int, bool]], str | None]:
    """The defect of a pair or None; the contexts at the end of an answer that is yet to be judged by them, and its last word if that is rare.

    ``margin``: nats between languages.
    """
    raw, broken = unwrap(answer)
    text = bare(raw)
    word = text.strip(" .…-–—*_()<>[]{}\"'`").lower()
    if not any(map(str.isalnum, text)) or word in PLACEHOLDERS:
        return "empty", [], None
    if question and _echo(question, text):
        return "echo", [], None
    low = text.lower().replace("’", "'")
    if _REFUSES.search(low) or _NOT_LATIN.search(low) and _REFUSES_ELSE.search(low):
        return "refusal", [], None
    if question and _other_language(question, text, asked, common, margin):
        return "language", [], None
    end = text.rstrip(_CLOSING)
    if not end or end[-1] in _STOP and not broken:
        return None, [], None
    tokens = _tokens(text.rstrip(_QUOTES))
    words = _shape(tokens, common)
    if len(words) == 1 and not broken:
        return None, [], None
    last = tokens[-1].lower() if words[-1] in "aA" and not _UNSPACED.match(tokens[-1]) else None
    return None, _context_hashes(words, [_word_hash(w) for w in words], len(words) - 1, _is_open(tokens, broken)), last


def defects(each: DataFrame, languages: Bayes, words: DataFrame, least: float = 0.08) -> DataFrame:
    """kind, record_id, defect of the defective pairs of (kind, record_id, question, answer).

    words: from word_counts of the same pairs. A null answer is empty; a pair without a question is no echo and has no
    language defect. ``least``: likelihood of an end. (kind, record_id) must be unique.
    """
    common = common_words(words, each.where(F.col("answer").isNotNull()).count())
    ends = end_counts(each, common)
    shared = each.sparkSession.sparkContext.broadcast((languages, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, held = shared.value
        asked = _Asked(bayes)
        for b in batches:
            found = [defect(q, a, asked, held) for q, a in zip(b.column("question").to_pylist(), b.column("answer").to_pylist())]
            keep = pa.array([i for i, (d, c, _) in enumerate(found) if d or c], pa.int64())
            found = [x for x in found if x[0] or x[1]]
            contexts = [np.array([h for h, _ in c], np.uint64).view(np.int64) for _, c, _ in found]
            own = pa.array([[o for _, o in c] for _, c, _ in found], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [b.column("kind").take(keep), b.column("record_id").take(keep), pa.array([d for d, _, _ in found], pa.string()), pa.array(contexts, pa.list_(pa.int64())), own, pa.array([w for _, _, w in found], pa.string())],
                names=["kind", "record_id", "defect", "contexts", "own", "word"],
            )

    judged = cut(each.mapInArrow(run, "kind string, record_id string, defect string, contexts array<bigint>, own array<boolean>, word string"))
    known = judged.where(F.col("defect").isNotNull()).select("kind", "record_id", "defect")
    open_ = judged.where(F.col("defect").isNull())
    last = open_.select("kind", "record_id", "word", F.posexplode(F.arrays_zip("contexts", "own")).alias("at", "c")).select("kind", "record_id", "word", "at", "c.own", F.col("c.contexts").alias("context"))
    d = last.join(ends.hint("merge"), "context", "left").select("kind", "record_id", "word", F.struct("at", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("n", F.lit(0)).alias("n"), "own").alias("c"))
    d = d.groupBy("kind", "record_id", "word").agg(end_likelihood(F.collect_list("c")).alias("p"))
    d = d.join(word_ends(words).hint("merge"), "word", "left")
    # the word's own occurrence is not counted
    whole = F.coalesce((F.col("ends") - 0.5) / (F.col("begins") - 0.5), F.lit(1.0))
    return known.unionByName(d.where(F.col("p") * whole < least).select("kind", "record_id", F.lit("truncated").alias("defect")))
