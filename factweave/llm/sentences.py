"""Sentence units across languages and scripts, by a pushdown automaton over characters.

The text is cut into blocks first: list lines, headings, and paragraphs whose lines are
joined where they were only wrapped. Inside a block the automaton keeps a stack of open
quotations and brackets; a script's terminators end a unit at the bottom of the stack,
unless a trie of abbreviations (read backwards from the mark), numbers, initials or
what follows speak against it. Thai has no terminator: its blanks are judged by
counts of what stands before and after them, learned from passages that are already
lists of sentences (spaces_model).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations without their last dot, lower case.
# Before a name, number or phrase: never the end of a unit.
BEFORE = """
mr mrs ms dr prof st sr sra srta dra drs rev hon gen col capt lt sgt maj gov sen rep pres messrs mme mlle mgr
fig figs sec secs no nos nr nrn vol vols ch chap eq eqs p pp pg art arts al par tab ed eds ex cf vs approx ca circa resp incl excl
jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun
e.g i.e viz z.b d.h u.a u.ä i.d.r s.o s.u v.a z.t bzw vgl abb abschn bd bsp ggf evtl geb gest hr fr frl hrn dipl ing mio mrd tsd zzgl bspw sog usf s
env éd chap c.-à-d p.ex cf réf m mm mmes
pág págs núm núms p.ej cap caps ud uds vd vds aprox ej d.ª dn
exmo exma nº nºs pag pagg p.es ad.es es sig sigg sig.ra sig.na dott dott.ssa avv prof.ssa egr spett ecc.mo
см рис стр табл гл ст п пп т.е т.к т.н т.о напр прим прибл д-р проф акад гг им ул пр пл
د ص أ م ج
डॉ पृ श्री सं क्र प्रो
ดร ศ รศ ผศ นพ พญ น.ส พ.ศ ค.ศ ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค
""".split()
# After a name or list: the end of a unit where a new one can begin.
AFTER = """
inc ltd corp co plc llc bros jr esq etc al a.m p.m u.s u.k u.n e.v s.a s.l s.r.l s.p.a s.a.s lda ltda cia
usw u.v.m u.dgl ag etc ecc др т.д т.п г гг в вв руб коп тыс млн млрд лет a.c d.c b.c a.d n.chr v.chr लि
""".split()
ORDINAL_AFTER = frozenset("am im zum vom beim dem der den des die das bis seit ab nach vor dieser diesem jeder jedem".split())

OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "［": "］", "»": "«"}
CLOSE = frozenset(chain(OPEN.values(), '"'))
FULL = "。．！？｡।॥؟۔"
_MARKS = re.compile(r"[.!?…。．！？｡।॥؟۔]+")
_PAIR = re.compile(r'[()\[\]{}“”„‟«»‹›「」『』（）【】《》〈〉〔〕［］"]')
_LIST = re.compile(r"\s*[-–•*‣▪◦·●○■□➢]\s+\S")
_ITEM = re.compile(r"\s*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\))\s+\S")
_HEAD = re.compile(r"\s*#{1,6}\s")
_THAI = re.compile("[฀-๿]")
_GAP = re.compile(r"\s+")
_NUMBER = re.compile(r"\d{1,2}")
_KANA_FIRST = re.compile("[ぁ-ゖァ-ヺ]")


def _trie(words: list[str], end: str, root: dict) -> dict:
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node.setdefault("", end)
    return root


TRIE = _trie(AFTER, "after", _trie(BEFORE, "before", {}))


def _abbreviation(text: str, dot: int, low: int) -> str | None:
    """``before``, ``after`` or None for the longest abbreviation that ends at the dot."""
    node, i, found = TRIE, dot - 1, None
    while i >= low:
        node = node.get(text[i].lower())
        if node is None:
            break
        if "" in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            found = node[""]
        i -= 1
    return found


def _blocks(text: str, thai: bool) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of each block; a whole block is one unit.

    ``levels`` is a stack of the indents of open list items. A line that is indented beyond the innermost one and goes on
    where the item left off is part of it; a line that is not closes the levels it does not reach.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line.rstrip()))
        at += len(line) + 1
    width = max(len(x) for _, x in lines)
    wraps = 55 <= width <= 100
    start = end = None
    before = ""
    levels: list[int] = []
    item: tuple[int, int, str] | None = None  # start, end and last line of the open item
    for at, line in lines:
        if not line.strip():
            if item:
                yield item[0], item[1], True
            if start is not None:
                yield start, end, False
            start, before, item = None, "", None
            levels.clear()
            continue
        body = line.lstrip("> \t") if line.startswith(">") else line
        head = bool(_HEAD.match(line))
        first = body.split(None, 1)[0] if body.split() else ""
        full = start is not None and wraps and len(before) + 1 + len(first) > width - (2 if line.startswith(">") else 0)
        # a number or letter opens an item only where the line before was not full
        listed = bool(_LIST.match(line)) or not full and bool(_ITEM.match(line))
        indent = len(line) - len(line.lstrip())
        held = len(levels)
        while levels and indent <= levels[-1]:
            levels.pop()
        if item:
            if len(levels) == held and not head and not listed and (first[:1].islower() or item[2][-1:] not in ".!?…" + FULL):
                item = item[0], at + len(line), line
                continue
            yield item[0], item[1], True
            item = None
        joins = full and not head and not listed
        if start is not None and not head and not listed and first[:1].islower():
            joins = True
        if start is not None and not joins:
            yield start, end, False
            start = None
        if head:
            yield at, at + len(line), True
            start, before = None, ""
            continue
        if listed and not joins:
            levels.append(indent)
            item = at, at + len(line), line
            start, before = None, ""
            continue
        if start is None:
            start = at
        end, before = at + len(line), line
    if item:
        yield item[0], item[1], True
    if start is not None:
        yield start, end, False


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Closing position -> opening position of the matched quotations and brackets of a block.

    Beside the stack, ``at`` holds the stack positions of each closing sign that is awaited, so
    that every sign is pushed, found and popped once.
    """
    stack: list[tuple[str, int]] = []
    at: dict[str, list[int]] = {}
    closed: dict[int, int] = {}
    last = text.rfind("«", start, end)

    def close(sign: str, i: int) -> None:
        k = at[sign][-1]
        closed[i] = stack[k][1]
        while len(stack) > k:
            at[stack.pop()[0]].pop()

    for m in _PAIR.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c in CLOSE and at.get(c):
            close(c, i)
        elif c == '"' or c in OPEN and (c != "»" or i < last):
            sign = OPEN.get(c, c)
            at.setdefault(sign, []).append(len(stack))
            stack.append((sign, i))
    return closed


def _begins(text: str, i: int, end: int) -> str:
    """What stands at i: upper, lower, digit, open, none (letters without case), other, end."""
    while i < end and text[i] in "¿¡—–- \"'“„«‹([{「『（【":
        if text[i] in "“„«‹([{「『（【¿¡\"":
            return "open"
        i += 1
    if i >= end:
        return "end"
    c = text[i]
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "none"
    return "other"


class _Token:
    """The token before a mark: where it starts, and whether it is a chain of letters and dots (``e.g``, ``U.S.A``).

    A token that runs on from the mark before is not read again.
    """

    def __init__(self) -> None:
        self.start, self.end, self.chain = 0, -1, False

    def read(self, text: str, a: int, b: int, low: int) -> tuple[int, bool]:
        stop = max(low, self.end)
        j = a
        while j > stop and not (text[j - 1].isspace() or text[j - 1] in "([{“„«\"'’"):
            j -= 1
        goes_on = j == self.end > low
        piece = text[j:a] if a - j <= 2 else ""
        chain = piece.isalpha() and (self.chain or not goes_on)
        self.start, self.end, self.chain = self.start if goes_on else j, b, chain and text[a:b] == "."
        return self.start, chain and goes_on


def _ends_unit(text: str, a: int, b: int, start: int, end: int, token: _Token) -> bool:
    """Whether the marks text[a:b], with no open quotation around and none closed after, end a unit."""
    j, dotted = token.read(text, a, b, start)
    if b >= end:
        return True
    marks, spaced = text[a:b], text[b].isspace()
    nxt = b
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return True
    kind = _begins(text, nxt, end)
    if any(c in FULL for c in marks):
        return text[nxt] not in "、，,;；:："
    if marks[-1] == "…" or len(marks) > 1 and set(marks) == {"."}:
        return kind in ("upper", "open", "digit", "none") if spaced else kind == "upper"
    if "!" in marks or "?" in marks:
        return kind != "other" if spaced else kind in ("upper", "open")
    before = text[a - 1] if a > start else " "
    if before.isspace():
        return spaced and kind in ("upper", "open")
    size = a - j
    if not spaced:
        if kind == "open":
            return not _abbreviation(text, a, start) and not before.isdigit()
        if kind != "upper" or text.find(".", j, a) >= 0 and not text[j].isdigit() or size < 2 or _abbreviation(text, a, start):
            return False
        return (before.islower() or before.isdigit() or before in ")]") and (nxt + 1 >= end or text[nxt + 1].islower() or text[nxt + 1].isspace())
    abbreviated = _abbreviation(text, a, start)
    if abbreviated == "before":
        return False
    if abbreviated == "after":
        return kind in ("upper", "open")
    if size == 1 and before.isalpha():
        return False
    if dotted:
        return kind in ("upper", "open")
    if size <= 2 and _NUMBER.fullmatch(text, j, a):
        k = j
        while k > start and text[k - 1].isspace():
            k -= 1
        if k == start:
            return False
        low = k
        while low > start and k - low < 12 and not text[low - 1].isspace():
            low -= 1
        if text[low:k].lower() in ORDINAL_AFTER and kind == "upper":
            return False
    return kind != "other"


def _context(text: str, i: int, j: int, start: int, end: int) -> tuple[str, str]:
    """What stands before and after the blank text[i:j], with names and numbers made alike."""
    mask = lambda s: re.sub(r"\d[\d.,/ ]*", "0", re.sub(r"[A-Za-z]+", "A", s))
    return mask(text[max(start, i - 24) : i])[-12:], mask(text[j : min(end, j + 24)])[:12]


def train_spaces(passages: list[list[str]]) -> dict[tuple[int, str], tuple[int, int]]:
    """Counts (ends a unit, doesn't) of the contexts of blanks, from lists of Thai sentences."""
    counts: dict[tuple[int, str], list[int]] = {}
    for elements in passages:
        parts = [e for e in elements if e and e.strip()]
        text, ends = "", set()
        for p in parts:
            if text:
                ends.add(len(text))
                text += " "
            text += p.strip()
        for m in _GAP.finditer(text):
            before, after = _context(text, m.start(), m.end(), 0, len(text))
            k = 0 if m.start() in ends else 1
            for n in range(1, len(before) + 1):
                counts.setdefault((0, before[-n:]), [0, 0])[k] += 1
            for n in range(1, len(after) + 1):
                counts.setdefault((1, after[:n]), [0, 0])[k] += 1
    return {c: (x, y) for c, (x, y) in counts.items() if x + y >= 3}


def _space_ends(model: dict, before: str, after: str) -> bool:
    """The side before the blank counts more: what begins a sentence also follows a lead-in."""
    score = 0.0
    if not model:
        return after[:1] not in "(0A" and before[-1:] not in ".A0"
    if re.match(r"\([^()]{1,10}\)", after):  # a short remark belongs to what it follows
        return False
    for side, weight, s in ((0, 1.6, before), (1, 1.0, after)):
        for n in range(len(s), 0, -1):
            c = model.get((side, s[-n:] if side == 0 else s[:n]))
            if c:
                score += weight * math.log((c[0] + 0.3) / (c[1] + 0.3))
                break
    return score > 0


def split(text: str | None, model: dict | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text, in order; none for null or blank text."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []

    def emit(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    has_thai = bool(_THAI.search(text))
    for start, end, whole in _blocks(text, has_thai):
        if whole:
            emit(start, end)
            continue
        closed = _pairs(text, start, end)
        inside: list[tuple[int, int]] = sorted((o, c) for c, o in closed.items())
        unit = start
        while unit < end and text[unit].isspace():
            unit += 1
        thai = has_thai and bool(_THAI.search(text, start, end))
        marks = [(m.start(), m.end()) for m in _MARKS.finditer(text, start, end)]
        if thai:
            marks = sorted(chain(marks, ((m.start(), m.end()) for m in _GAP.finditer(text, start, end))))
        outer, k, token = [], 0, _Token()  # outermost pairs in order
        for o, c in inside:
            if not outer or o > outer[-1][1]:
                outer.append((o, c))
        for a, b in marks:
            if a < unit:
                continue
            while k < len(outer) and outer[k][1] < a:
                k += 1
            around = outer[k] if k < len(outer) and outer[k][0] < a else None
            if text[a].isspace():  # a blank in a Thai block
                if around is None and a > unit and _space_ends(model or {}, *_context(text, a, b, start, end)):
                    emit(unit, a)
                    unit = b
                continue
            if around is None:
                if thai and "." in text[a:b]:
                    continue
                if _ends_unit(text, a, b, unit, end, token):
                    emit(unit, b)
                    unit = b
                    while unit < end and text[unit].isspace():
                        unit += 1
                continue
            # inside a quotation or bracket: only marks just before its end can count
            o, c = around
            i = b
            while i < c and (text[i].isspace() or text[i] in CLOSE):
                i += 1
            if i != c:
                continue
            i = c + 1
            nxt = i
            while nxt < end and text[nxt].isspace():
                nxt += 1
            kind = _begins(text, nxt, end)
            spaced = i < end and text[i].isspace()
            if kind == "end":
                ends = True
            elif o == unit:
                ends = kind in ("upper", "open", "digit", "none") and not (not spaced and _KANA_FIRST.match(text, i))
            else:
                ends = kind in ("upper", "open") and spaced and text[c] not in ")]}）】］"
            if ends and i < end and text[i] in ".,;:!?…。，、":
                ends = False
            if ends:
                emit(unit, i)
                unit = i
                while unit < end and text[unit].isspace():
                    unit += 1
        emit(unit, end)
    return out


def spaces_model(passages: DataFrame, most: int = 4000) -> dict:
    """The model of Thai blanks, from at most ``most`` Thai passages (those with the smallest hash)."""
    thai = passages.where(F.array_join("sentences", " ").rlike("[฀-๿]"))
    rows = thai.select("sentences", F.xxhash64("passage_id").alias("h")).orderBy("h").limit(most).collect()
    return train_spaces([[e for e in r.sentences if e] for r in rows])


def units(records: DataFrame, model: dict) -> DataFrame:
    """kind, record_id, sentence_no, start_char, end_char of every unit of (kind, record_id, text).

    Null and blank texts have no rows. Offsets count characters from 0.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kinds, ids, nos, starts, ends = [], [], [], [], []
            for kind, rid, text in zip(f["kind"].tolist(), f["record_id"].tolist(), f["text"].tolist()):
                for no, (a, b) in enumerate(split(text, shared.value), 1):
                    kinds.append(kind)
                    ids.append(rid)
                    nos.append(no)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"kind": kinds, "record_id": ids, "sentence_no": nos, "start_char": starts, "end_char": ends})

    return records.mapInPandas(run, "kind string, record_id string, sentence_no int, start_char int, end_char int")


def records(sections: DataFrame, passages: DataFrame) -> DataFrame:
    """kind, record_id, text of sections and passages; a record counts once, null ids not at all."""
    a = sections.where(F.col("section_id").isNotNull()).dropDuplicates(["section_id"]).select(F.lit("section").alias("kind"), F.col("section_id").cast("string").alias("record_id"), "text")
    joined = F.array_join(F.transform("sentences", lambda x: F.coalesce(x, F.lit(""))), " ")
    b = passages.where(F.col("passage_id").isNotNull()).dropDuplicates(["passage_id"]).select(F.lit("passage").alias("kind"), F.col("passage_id").alias("record_id"), joined.alias("text"))
    return a.unionByName(b)
