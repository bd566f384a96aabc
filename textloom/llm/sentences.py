"""Sentence boundaries in ten languages, found by a pushdown automaton over the text.

The automaton reads only marks: terminators, quotes, brackets, line ends and the bullets and numbers
of list items. One stack holds the open quotes and brackets; nothing inside them ends a sentence.
Another holds the open list levels: they tell whether a number opens an item, and whether a line
goes on with one. Abbreviations are looked up in a trie read backwards from the full stop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations by what may follow them, all languages together.
#: Before a name; a capital after them opens no sentence.
TITLES = "Dr Drs Prof Mr Mrs Ms Mx St Ste Hr Fr Frl Mme Mlle MM Sr Sra Srta Dra Rev Gen Col Capt Hon Ing Mag Dipl Priv Doz проф акад доц тов г-н г-жа डॉ श्री प्रो د أ م".split()
#: Before a number; otherwise the stop ends the sentence.
NUMBERED = "Fig Figs Tab Tabs Eq Eqs No Nos Nr Nrn Vol Vols Ch Chap Chaps Sec Secs Sect Para Paras Art Arts p pp S Bd Abb Abs Kap Ziff n núm pág págs fig cap tab t vol ch рис табл гл стр с п ст разд".split()
#: Never at the end of a sentence.
INNER = [
    *"e.g i.e cf vs viz approx ca resp incl vgl z.B d.h u.a bzw ggf evtl zit sog p.ex c.-à-d env p.ej aprox см т.е т.к ср напр".split(),
    *("z. B", "d. h", "u. a", "i. d. R", "p. ex", "p. ej", "т. е", "т. к"),
]
#: Anywhere; the stop ends the sentence where one may begin after it.
EITHER = [*"etc usw a.m p.m al ff f Ltd Inc Co Corp S.A Jr Bros et.al u.s.w т.д т.п др г гг".split(), "et al", "т. д", "т. п", "и др"]
#: What the letter before a stop belongs to, when it is no initial.
LETTERED = frozenset("vitamin vitamins vitamine vitamina vitaminas hepatitis type class group grade part teil section figure table appendix factor protein option schedule typ gruppe klasse groupe clase grupo tipo".split())
#: German nouns after an ordinal, which looks like a number and a stop.
ORDINAL_NOUNS = frozenset(
    "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Abschnitt Kapitel Band Teil Jahrhundert Jahrestag Mal Tag Monat Woche Jahr Stock Auflage Ausgabe Abteilung Klasse Absatz Satz Paragraph Paragraf Artikel Buch Semester Quartal Platz Rang".split()
)
_FOLLOWERS = frozenset("KG OHG Inc Ltd LLC KGaA".split())

CLOSERS = "\"”“»«›’')]）】」』》〉"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", '"': '"', "”": "”"}
#: The marks that each mark closes.
_CLOSED_BY = {ch: [own for own, closers in _PAIRS.items() if ch in closers] for ch in set("".join(_PAIRS.values()))}
_OPENS = re.compile("[" + re.escape("".join({*_PAIRS, *_CLOSED_BY} - {'"', "”"})) + "”]")
_CLOSE = frozenset("”“»«›)]）」』】》\"")

_BREAK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*\r\n\s*")
_BULLET = re.compile(r"[^\S\n]*(?:\*{1,4}|[•‣▪◦●·‐\-])[^\S\n]+\S")
_NUMBERED = re.compile(r"[^\S\n]*(?:\(?\d{1,2}[.)]|[a-z]\))[^\S\n]+\S")
_PATH = re.compile(r"[^\S\n]*\(?(?:(\d{1,2}(?:\.\d{1,2})*)[.)]?|([a-z])\)|([IVX]{1,5})[.)])[^\S\n]+\S")
#: Roman numerals of list items.
_ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
_INDENT = re.compile(r"[^\S\n]*")
_MARK = re.compile(r"[.!?…。！？．｡।॥؟۔]+|[“”„«»‹›()\[\]（）「」『』【】《》\"]|\n")
_AFTER = re.compile(rf"(?:[{re.escape(CLOSERS)}]|</\w+>|<sup>[^<>]*</sup>|[¹²³⁴-⁹⁰]|[^\S\n]+[»”](?=[\s,.]|$))*")
_BLANK = re.compile(r"[\s​﻿]*")
_ENDS = re.compile(r"[\s​﻿]+$")
_SHORT = re.compile(r"[^\W\d_]{1,2}\.")
_WORD = re.compile(r"[^\W\d_]+")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿A-Z\"“(])")
_FULL = frozenset("。！？．｡।॥")
_TALK = re.compile(r"\s*(?:と|って|[^。！？“”「」\n]{0,40}(?:写道|说|說|问|問|答|指出|认为|記|述べ|言))")


def _trie(kinds: dict[str, list[str]]) -> dict:
    root: dict = {}
    for kind, words in kinds.items():
        for word in words:
            # a single letter counts only as listed: in the other case it is an initial
            for form in {word} if len(word) == 1 else {word, word.upper()} if kind == "title" else {word, word[:1].upper() + word[1:], word.upper()}:
                node = root
                for ch in reversed(form):
                    node = node.setdefault(ch, {})
                node[""] = kind
    return root


_ABBREVIATIONS = _trie({"title": TITLES, "number": NUMBERED + [w.lower() for w in NUMBERED if w.isascii() and len(w) > 1], "inner": INNER, "either": EITHER})


def _abbreviation(text: str, stop: int, start: int) -> str:
    """The kind of the longest abbreviation that ends before the stop, on a word's start."""
    node, at, kind = _ABBREVIATIONS, stop, ""
    while at > start:
        ch = text[at - 1]
        node = node.get(" " if ch in "  \n\t" else ch)
        if node is None:
            break
        at -= 1
        if "" in node and (at == start or not (text[at - 1].isalnum() or text[at - 1] in "-_")):
            kind = node[""]
    return kind


def _opens(text: str, at: int, end: int) -> bool:
    """Whether what stands at ``at`` can open a sentence: no small letter, but mRNA or pH can."""
    while at < end and text[at] in "\"“„«»‹([¿¡（「『'‘*_":
        at += 1
        while at < end and text[at] in "   ":
            at += 1
    if at >= end:
        return True
    ch = text[at]
    if not ch.islower():
        return ch not in ",;:)]»”-–—"
    word = _WORD.match(text, at, end)
    return bool(word) and any(c.isupper() for c in word.group()[1:3])


def _ends_here(text: str, mark: int, after: int, tail: int, start: int, end: int) -> bool:
    """Whether the terminator text[mark:after], with closers up to ``tail``, ends the sentence."""
    if tail >= end:
        return True
    last, run = text[after - 1], after - mark
    nxt = _BLANK.match(text, tail, end).end()
    if nxt >= end:
        return True
    if last in _FULL:
        return True
    spaced = nxt > tail
    if not spaced:
        # no blank after the stop: decimals, names of variants, hosts; but also blanks that got lost
        if last in "!?؟":
            return text[nxt].isalpha() and not text[nxt].islower()
        before = text[mark - 1] if mark > start else ""
        if last != "." or run > 1 or not text[nxt].isupper() or nxt + 1 < end and not (text[nxt + 1].islower() or text[nxt + 1].isspace() or text[nxt + 1] == "." and before.islower()):
            if not (last == "." and run == 1 and text[nxt] in "\"“„«¿¡(" and tail == after and before.islower()):
                return False
        if tail == after and not (before.islower() or before.isdigit() or before in "%)"):
            return False
        if tail == after and before.islower() and (mark - 2 < start or not text[mark - 2].isalpha()) and text[mark - 3 : mark] not in ("a.m", "p.m"):
            return False
    if last in "!?؟" and tail == after:
        return True
    if not _opens(text, nxt, end):
        # after a full stop that is no abbreviation's, a small letter is careless typing
        plain = last == "." and run == 1 and tail == after and text[nxt].islower() and mark - 2 >= start
        return plain and (text[mark - 1] in "%)°" or text[mark - 1].isdigit() or text[mark - 2 : mark].isalnum()) and not _abbreviation(text, mark, start)
    if last != "." or run > 1:
        return True
    if tail > after and text[after:tail].strip():
        return True  # closed by a quote or bracket
    kind = _abbreviation(text, mark, start)
    if kind in ("inner", "title"):
        return False
    lone = mark - 2 < start or not (text[mark - 2].isalnum() or text[mark - 2] in "-−_'’")
    if kind == "number" and not (lone and text[mark - 1].isupper() and text[nxt].isupper()):
        return not text[nxt].isdigit()
    word = _WORD.match(text, nxt, end)
    if kind == "either":
        return not (word and word.group() in _FOLLOWERS)
    before = text[mark - 1] if mark > start else ""
    if before.isalpha() and lone:
        if before.islower() and _SHORT.match(text, nxt, end):
            return False  # the first part of an abbreviation in two
        # a letter by itself is an initial, unless it names a vitamin, group or part
        if before.isupper() or not before.islower():
            lead = text[max(start, mark - 24) : mark - 1].rstrip()
            named = re.search(r"[^\W\d_]+$", lead)
            return bool(named) and named.group().lower() in LETTERED
    if before.isdigit() and word and word.group() in ORDINAL_NOUNS:
        number = re.search(r"(?:^|[^\w.,])(\d{1,3})$", text[max(start, mark - 5) : mark])
        if number:
            return False
    if (before.isdigit() or before in "IVX") and re.fullmatch(r"\s*\(?(?:\d{1,2}(?:\.\d{1,2}){0,5}|[IVX]{2,5})", text[start : min(mark, start + 40)]):
        return False  # the number of a list item
    return True


def _closers(text: str, start: int, end: int) -> dict[int, int]:
    """Where each opened mark of a block is closed, by one stack a kind of mark; a stray one is missing."""
    open_: dict[str, list[int]] = {}
    closed: dict[int, int] = {}
    for mark in _OPENS.finditer(text, start, end):
        ch = mark.group()
        for own in _CLOSED_BY.get(ch, ()):
            if open_.get(own):
                closed[open_[own].pop()] = mark.start()
            elif own == ch:
                open_.setdefault(ch, []).append(mark.start())
        if ch in _PAIRS and ch not in _PAIRS[ch]:
            open_.setdefault(ch, []).append(mark.start())
    return closed


def _block(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Raw units of one block: a run of lines without a list item or empty line."""
    stack: list[tuple[int, int]] = []  # (closing position, opening position)
    closers: dict[int, int] | None = None
    begin, skip = start, start
    for mark in _MARK.finditer(text, start, end):
        at, ch = mark.start(), mark.group()[0]
        if at < skip or ch == "\n":
            continue
        while stack and at > stack[-1][0]:
            stack.pop()
        if stack and at == stack[-1][0]:
            opened = stack.pop()[1]
            if stack or text[at] in ")]）】":
                continue
            # a quotation that ended with a terminator may end the sentence with it
            if text[at - 1] in "。！？" and text[at] in "”」』》\"":
                lead = _BLANK.match(text, begin, end).end()
                follows = _BLANK.match(text, at + 1, end).end()
                if opened > lead or not _TALK.match(text, at + 1, end) or follows >= end:
                    yield begin, at + 1
                    begin = skip = at + 1
            elif text[at - 1] in ".!?…؟" or text[at - 1] in "   " and text[at - 2] in ".!?…":
                inner = at - 1
                while text[inner] in "   ":
                    inner -= 1
                first = inner
                while first > begin and text[first - 1] in ".!?…؟":
                    first -= 1
                tail = _AFTER.match(text, at, end).end()
                if _ends_here(text, first, inner + 1, tail, begin, end):
                    yield begin, tail
                    begin = skip = tail
            continue
        if ch in _PAIRS and (ch not in "”»" or ch == "»" and (at + 1 < end and text[at + 1].isalpha())):
            if ch in "\"”":  # the next one closes it
                close = -1 if stack else text.find(ch, at + 1, end)
            else:
                closers = _closers(text, start, end) if closers is None else closers
                close = closers.get(at, -1)
            if close > at and (not stack or close < stack[-1][0]):
                stack.append((close, at))
            continue
        if stack or ch in _CLOSE:
            continue
        tail = _AFTER.match(text, mark.end(), end).end()
        # a quote right after the terminator that opens the next sentence isn't a closer
        piece = text[mark.end() : tail]
        if piece and piece[0] in "\"“«„" and tail < end and text[tail].isalnum():
            tail = mark.end()
        if _ends_here(text, at, mark.end(), tail, begin, end):
            yield begin, tail
            begin = skip = tail
    if begin < end:
        yield begin, end


def _number(line: re.Match | None) -> tuple[int, ...]:
    """The number of an item as a path; letters and Roman numerals are paths of their own kind."""
    if not line:
        return ()
    digits, letter, roman = line.groups()
    if digits:
        return tuple(map(int, digits.split(".")))
    if letter:
        return -1, ord(letter) - 96
    return (-2, _ROMAN.index(roman) + 1) if roman in _ROMAN else ()


def _goes_on(levels: list[tuple[int, tuple[int, ...]]], path: tuple[int, ...]) -> bool:
    """Whether a number is the next one, or the first below, of an open list level."""
    return any(own and path in ((*own[:-1], own[-1] + 1), (*own, 1)) for _, own in levels)


def _units(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for stop in [*_BREAK.finditer(text), None]:
        end = stop.start() if stop else len(text)
        # within a paragraph, list items are units of their own; each open level is its indent and number
        levels: list[tuple[int, tuple[int, ...]]] = []
        line, run, fresh = at, at, True
        item, lines = False, 0  # whether the text from `run` on is an item, and its lines so far
        while line < end:
            nl = text.find("\n", line, end)
            nl = end if nl < 0 else nl
            indent = _INDENT.match(text, line, nl).end()
            path = _number(_PATH.match(text, line, nl))
            # a number opens an item only where a line can't be running on, or where a list level expects it
            if _BULLET.match(text, line, nl) or (fresh or item and lines == 1) and _NUMBERED.match(text, line, nl) or path and _goes_on(levels, path):
                if run < line:
                    yield from _item(text, run, line, lines) if item else _block(text, run, line)
                depth = indent - line
                while levels and (levels[-1][1] != path[: len(levels[-1][1])] or len(path) == len(levels[-1][1]) if path and levels[-1][1] else levels[-1][0] >= depth):
                    levels.pop()
                levels.append((depth, path))
                run, item, lines = line, True, 1
            elif item and nl > indent and (indent - line > levels[-1][0] or not fresh and text[indent].islower()):
                lines += 1  # the item runs on
            elif item:
                yield from _item(text, run, line, lines)
                run, item, levels = line, False, []
            if not item and fresh and path == (-2, 1):
                levels = [(indent - line, path)]  # an initial, unless a second numeral follows
            fresh = text[line:nl].rstrip()[-1:] in ".!?:;"
            line = nl + 1
        if run < end:
            yield from _item(text, run, end, lines) if item else _block(text, run, end)
        at = stop.end() if stop else len(text)


def _item(text: str, start: int, end: int, lines: int) -> Iterator[tuple[int, int]]:
    """An item on one line is one unit; one that is wrapped may hold several sentences."""
    if lines > 1:
        yield from _block(text, start, end)
    else:
        yield start, end


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in code points, without outer blanks."""
    out: list[tuple[int, int]] = []
    for start, end in _units(text):
        begin = _BLANK.match(text, start, end).end()
        cuts = [(m.start(), m.end()) for m in _THAI.finditer(text, begin, end)] if begin < end else []
        for cut, resume in [*cuts, (end, end)]:
            tail = _ENDS.search(text, begin, cut)
            stop = tail.start() if tail else cut
            if begin < stop:
                out.append((begin, stop))
            begin = resume
    return out


def split_sentences(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns ``doc_id, sentence, start_char, end_char, sentence_text``; ``sentence`` counts from 1.

    Offsets are code points from 0, the end exclusive. Null and blank texts give no rows, repeated
    rows give repeated sentences, and texts of any length are read whole, in one pass.
    """
    source = df.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").cast("string").alias("__text")).filter(F.length("__text") > 0)
    schema = T.StructType(
        [source.schema[0]] + [T.StructField(c, T.IntegerType()) for c in ("sentence", "start_char", "end_char")] + [T.StructField("sentence_text", T.StringType())]
    )

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (key, i, s, e, body[s:e])
                for key, body in frame.itertuples(index=False, name=None)
                for i, (s, e) in enumerate(sentences(body), 1)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(split, schema)
