"""Sentence boundaries in any language: character-property rules, abbreviations, quotations, headings and lists."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import spread


def _with_property(value: str) -> str:
    """All characters whose Sentence_Break property has the value, of the Unicode data of the regex library."""
    all_chars = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", all_chars))


STERM = _with_property("STerm") + "…"
ATERM = _with_property("ATerm")
_PAIRS = {"(": ")", "[": "]", "«": "»", "「": "」", "『": "』", "（": "）", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "“": "”", "‘": "’", "„": "“”", "‚": "‘’", "‹": "›", '"': '"'}
_QUOTES = frozenset("«「『《〈“‘„‚‹\"")
_CLOSERS = frozenset("".join(_PAIRS.values()))
_MARK = re.compile(rf"\(\)|[{re.escape(''.join(_PAIRS))}{re.escape(''.join(_CLOSERS))}]|[{re.escape(STERM + ATERM)}]+")
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[^\S]+(?=[ก-ฺเ-๎])")
_OPENER = re.compile(rf"[{re.escape(''.join(_PAIRS))}]")
_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
_BULLET = re.compile(r"\s*[-*•‣◦–+]\s+\S")
_NUMBERED = re.compile(r"\s*(?:\d{1,3}|[a-zA-Z])[.)]\s+\S")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_RULE = re.compile(r"\s*(?:=+|-{2,}|\*{3,}|_{3,})\s*$")
_LAST_WORD = re.compile(r"[^\W_][\w’'.-]*\Z")
_CODE = re.compile(r"`|[^\W\d]*[_\d][\w.]*|[^\W\d_]+\.\w|[^\W\d_]*[a-z][A-Z]|[^\W\d_]+\(")
_GLUED_WORD = re.compile(r"[^\W\d_]+(?=[\s,’'-]|\.\s|\Z)")
_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"\S+")

#: Fixed lists of abbreviations by language. ``never`` doesn't end a sentence, ``number`` doesn't before a digit,
#: ``end`` may: it does before a capital, a quotation or a name in code. ``early`` are those after which a clause that has just
#: begun goes on, whatever follows. ``split`` has first parts of abbreviations written in parts with what follows them, and
#: ``second`` such pairs that never end a sentence.
ABBREVIATIONS = {
    "en": {"never": "e.g i.e cf v vs viz Mr Mrs Ms Dr Prof St Gen Rev Hon Mt al", "number": "No Nos Fig Figs fig figs sec Sec secs ref Ref refs approx ca Vol vol p pp ch Ch eq Eq Art art par", "end": "etc Inc Ltd Co Corp Bros Jr Sr U.S U.K a.m p.m A.M P.M dept est", "early": "a.m p.m A.M P.M U.S U.K", "split": {"U": "S K", "a": "m", "e": "g", "i": "e"}, "second": "e.g i.e"},
    "de": {"never": "bzw vgl z.B d.h u.a s.o sog evtl ggf inkl zzgl Hr Fr Dipl Ing Dr Prof St", "number": "Nr Abb Kap Bd Tab Abs ca S Art Ziff Vol", "end": "usw etc GmbH", "split": {"z": "B", "d": "h", "u": "a Ä", "s": "o u"}, "second": "z.B d.h u.a s.o"},
    "fr": {"never": "p.ex c.-à-d cf MM Mme Mlle Me Dr Prof St", "number": "art env fig chap n nº p vol", "end": "etc", "split": {"p": "ex", "c": "-à-d"}, "second": "p.ex"},
    "es": {"never": "p.ej p.ex EE Sr Sra Srta D Dña ej ex Dr Dra Prof", "number": "núm aprox pág págs art fig cap vol n.º", "end": "etc UU EE.UU Ud Uds", "early": "UU EE.UU", "split": {"p": "ej ex", "EE": "UU"}, "second": "p.ej p.ex"},
    "ru": {"never": "т.е т.к т.н См см напр им ул е", "number": "рис ок стр гл табл п пп ст", "end": "г гг др т.д т.п руб тыс млн", "early": "г гг", "split": {"т": "е д п к н", "и": "т"}, "second": "т.е т.к т.н"},
    "hi": {"never": "डॉ प्रो पं", "number": "नं सं", "end": ""},
    "ar": {"never": "د أ", "number": "ص", "end": ""},
    "th": {"never": "ดร พ.ศ ค.ศ น.ส", "number": "", "end": ""},
}
#: Fixed lists of frequent words by which the languages of Latin letters are told apart.
FREQUENT = {
    "en": "the and of to is that in it for with was on not this are be we you from when but which have",
    "de": "der die das und ist nicht ein eine mit auf für den dem zu von wird werden nur bei auch wenn seit sich hat als noch nach im am",
    "fr": "le la les et est une des dans pour que pas avec sur au aux ce cette quand mais qui nous vous",
    "es": "el los las y es una de en para que con por del se pero cuando como más está son lo",
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _ws in FREQUENT.items():
    for _w in _ws.split():
        _BY_WORD.setdefault(_w, []).append(_lang)
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("ru", re.compile("[а-яё]", re.I)), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("th", re.compile("[฀-๿]")))
#: Least share of a language among the frequent words for its abbreviations to count.
SPOKEN = 0.1


def languages(text: str) -> frozenset[str]:
    """The languages a text is written in, by its scripts and its frequent words; all of them if nothing tells.

    A text may quote another language, so each with a share of SPOKEN counts.
    """
    hits = dict.fromkeys(FREQUENT, 0)
    for w in _LETTERS.findall(text.lower()):
        for lang in _BY_WORD.get(w, ()):
            hits[lang] += 1
    total = sum(hits.values())
    found = {lang for lang, n in hits.items() if n and n >= SPOKEN * total}
    if not text.isascii():
        found |= {lang for lang, script in _SCRIPTS if script.search(text)}
    return frozenset(found or ABBREVIATIONS)


class Suppression:
    """The abbreviations of some languages."""

    def __init__(self, langs: frozenset[str]):
        lists = [x for lang, x in ABBREVIATIONS.items() if lang in langs]
        words = lambda kind: frozenset(w for x in lists for w in x.get(kind, "").split())
        self.never, self.number, self.end, self.early = (words(k) for k in ("never", "number", "end", "early"))
        self.split: dict[str, set[str]] = {}
        for x in lists:
            for first, rest in x.get("split", {}).items():
                self.split.setdefault(first, set()).update(rest.split())
        self.second = frozenset(tuple(w.split(".", 1)) for w in words("second"))


suppression = lru_cache(maxsize=256)(Suppression)
_SECOND = re.compile(r"([^\W\d_]+)\.\s+([^\W\d_]+)\Z")
#: Month names that follow an ordinal with a full stop.
_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember januar februar marts april maj juni juli august september oktober november december".split())


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a block, as (place of the opener, place of the closer)."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, start, end):
        c = m.group()
        if len(c) > 1 or (c not in _PAIRS and c not in _CLOSERS):
            continue
        at = m.start()
        if c in "’‘" and at + 1 < end and at > start and text[at - 1].isalnum() and text[at + 1].isalnum():
            continue
        if c in _CLOSERS:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[d][0]]), -1)
            if depth >= 0:
                found.append((stack[depth][1], at))
                del stack[depth:]
                continue
        if c in _PAIRS:
            stack.append((c, at))
    found.sort()
    out: list[tuple[int, int]] = []
    for s, e in found:
        if not out or s > out[-1][1]:
            out.append((s, e))
    return out


def _goes_on(text: str, at: int, end: int) -> bool:
    """Whether what stands at ``at`` is an ordinary word in lower case."""
    return at < end and text[at].islower() and not _CODE.match(text, at, end)


def _glued(text: str, stop: int, nxt: int, end: int, opened: set[int]) -> bool:
    """Whether a new sentence begins right at ``nxt`` though no blank stands after the mark at ``stop``."""
    before, ch = text[stop - 1 : stop], text[nxt]
    if not (before.isalnum() or before in ")`%”’»"):
        return False
    if ch in "¿¡«“‘„`" or (ch == "(" and text[nxt + 1 : nxt + 2].isupper()) or (ch in _PAIRS and ch in _QUOTES and nxt in opened):
        return True
    word = _GLUED_WORD.match(text, nxt, end)
    if ch.isupper():
        return bool(word) and not (before.isupper() and text[stop - 2 : stop - 1] in ". ") and text[max(0, stop - 3) : stop] not in ("a.m", "p.m")
    return ch.isalpha() and not ch.islower() and not ch.isascii()


def _ends_at_stop(text: str, stop: int, nxt: int, end: int, begin: int, rules: Suppression) -> bool:
    """Whether the full stop at ``stop``, followed by blanks up to ``nxt``, ends the sentence that began at ``begin``."""
    m = _LAST_WORD.search(text, max(begin, stop - 24), stop)
    word = re.split(r"['’](?=[^\W\d_]{2})", m.group())[-1] if m else ""
    ch = text[nxt]
    follows = re.compile(r"[^\W\d_]+").match(text, nxt, end)
    if word:
        if word.isdigit():
            if follows and follows.group() in _MONTHS:
                return False
        elif follows and follows.group() in rules.split.get(word, ()):
            return False
        two = _SECOND.search(text, max(begin, stop - 24), stop)
        second = two and two.groups()
        if second in rules.second:
            return False
        early = word in rules.early or (second and ".".join(second) in rules.early)
        may_end = word in rules.end or (second and ".".join(second) in rules.end)
        if may_end or early:
            if early and len(_WORD.findall(text, begin, stop)) <= 4:
                return False
            return not _goes_on(text, nxt, end)
        if word in rules.never or (word in rules.number and ch.isdigit()):
            return False
        if len(word) == 1 and word.isupper() and word.isascii() and ch.isupper() and not (m.start() > begin and text[m.start() - 1] in "`_"):
            return False
    return not _goes_on(text, nxt, end)


def _paragraph(text: str, start: int, end: int, ends: list[int], rules: Suppression) -> None:
    """Ends of the sentences of one paragraph, whose last character is at ``end - 1``."""
    spans = _pairs(text, start, end) if _OPENER.search(text, start, end) else []
    begin, skip, k = start, start, 0
    cuts: list[int] = []
    marks = [(m.start(), m.end(), m.group()) for m in _MARK.finditer(text, start, end)]
    for at, stop, mark in marks:
        if at < skip or mark == "()":
            continue
        while k < len(spans) and spans[k][1] < at:
            k += 1
        if k < len(spans) and spans[k][0] <= at:
            opened, closed = spans[k]
            skip = closed + 1
            inner = text[opened + 1 : closed].rstrip()
            while inner and inner[-1] in _CLOSERS:
                inner = inner[:-1].rstrip()
            nxt = _SPACE.match(text, closed + 1, end).end()
            if inner and inner[-1] in STERM + ATERM and nxt < end and nxt > closed + 1:
                if text[opened] in _QUOTES:
                    ch = text[nxt]
                    ordinary = ch.isupper() and not _CODE.match(text, nxt, end)
                    if ordinary:
                        cuts.append(closed + 1)
                        begin = nxt
                elif opened == begin:
                    cuts.append(closed + 1)
                    begin = nxt
            continue
        if mark[0] not in STERM and mark[0] not in ATERM:
            continue
        nxt = _SPACE.match(text, stop, end).end()
        if nxt >= end:
            break
        if mark in ATERM:
            if nxt == stop:
                if not _glued(text, at, nxt, end, {a for a, _ in spans}):
                    continue
            elif not _ends_at_stop(text, at, nxt, end, begin, rules):
                continue
        elif set(mark) <= {".", "…"}:
            if nxt == stop or text[at - 1 : at].isspace() or not text[nxt].isupper() or _CODE.match(text, nxt, end):
                continue
        elif mark.isascii() and nxt == stop and not _glued(text, at, nxt, end, {a for a, _ in spans}):
            continue
        cuts.append(stop)
        begin = nxt
    if cuts or any("฀" <= c <= "๿" for c in text[start:end:7]) or "฀" < max(text[start:end]):
        inside = lambda p: any(s < p <= e for s, e in spans)
        cuts += [m.start() for m in _THAI_GAP.finditer(text, start, end) if not inside(m.start())]
    cuts.append(end)
    ends += sorted(set(cuts))


def sentence_ends(text: str) -> list[int]:
    """The ends of all sentences of a text, in characters from its start.

    Blank lines end a sentence; a heading and a list item are one each; a single line break in a paragraph ends none.
    Blank texts have none. Marks inside a matched quotation or bracket end nothing; the sentence goes on after it, unless
    it closed with a final mark and a new one visibly begins. Abbreviations are those of the languages the text is written in.
    """
    ends: list[int] = []
    rules = suppression(languages(text))
    first = last = -1
    item = False

    def flush() -> None:
        nonlocal first, last, item
        if first >= 0:
            if item:
                ends.append(last)
            else:
                _paragraph(text, first, last, ends, rules)
        first, item = -1, False

    for m in _LINE.finditer(text):
        line = m.group(1)
        body = line.strip()
        if not body:
            flush()
        else:
            s = m.start() + len(line) - len(line.lstrip())
            e = m.start() + len(line.rstrip())
            if _HEADING.match(line):
                flush()
                ends.append(e)
            elif first >= 0 and not item and _RULE.match(line):
                flush()
            elif _BULLET.match(line) or (_NUMBERED.match(line) and (first < 0 or item)):
                flush()
                first, last, item = s, e, True
            else:
                first = s if first < 0 else first
                last = e
        if m.end() == len(text):
            break
    flush()
    return ends


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = [sentence_ends(t) for t in b.column("text").to_pylist()]
        sizes = [len(e) for e in ends]
        flat = [x for e in ends for x in e]
        numbers = [i for n in sizes for i in range(1, n + 1)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(numbers, pa.int32()), pa.array(flat, pa.int32())], names=["id", "number", "end_pos"]
        )


def sentences(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, number, end_pos) of each sentence of each text, numbered from 1. No shuffle is needed.

    Rows with a null id or text give nothing, blank texts have no sentences, repeated rows give repeated rows, and texts of
    any length are read whole. Other columns are ignored.
    """
    src = spread(texts.select(F.col(ident).alias("id"), F.col(text).alias("text")).where("id is not null and text != ''"))
    return src.mapInArrow(_rows, f"id {dict(src.dtypes)['id']}, number int, end_pos int")
