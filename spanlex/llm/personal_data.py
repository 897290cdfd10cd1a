"""Personal information in free text, found by a semi-Markov conditional random field.

Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``name``. A text is divided into segments: spans of
a kind, and single characters outside. The score of a division is the sum of the scores of its spans; a
span is scored as a whole, by features of its shape, its words and what stands around it. The best division
is found by dynamic programming over span boundaries, jointly for boundaries and kinds. Spans are bounded in
length and have to satisfy a broad pattern of their kind. Where no such span exists only the outside is
possible, so a text falls into islands of overlapping spans that are decided apart from each other, exactly.

Weights are learned by maximum likelihood on labelled texts (``personal_training``) and stored with the
package.

Defined results: null and empty texts have no spans and are left as they are; texts of any length are
searched whole; of equal passages of a document one row is given; every run of white space of a passage is
given as one space; repeated rows of a document come out once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from spanlex.llm.text_quality import FUNCTION_WORDS

KINDS = ("email", "phone", "id_number", "address", "name")
MODEL = "personal_model.json"
#: Longest span, in characters and in words of a name.
LONGEST, NAME_WORDS = 120, 7


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- spans that may be something -------------------------------------------------------------------

#: White space inside a passage: one or two blanks, or a line end with the padding around it.
_S = r"(?:[ \t\xa0]{1,2}|[ \t\xa0]{0,60}\r?\n[ \t\xa0]{0,60})"
_AT = rf"{_S}?(?:@|\(at\)|\[at\]|\{{at\}}){_S}?"
_DOT = rf"(?:\.|{_S}?(?:\(dot\)|\[dot\]|\{{dot\}}){_S}?)"
_EMAIL = re.compile(rf"[\w.+\-]+{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+", re.I)
_GAP_BEFORE = re.compile(rf"{_S}$")
_AT_SIGN = re.compile(r"@|[(\[{]at[)\]}]", re.I)
#: Digits with usual separators, six at least.
_DIGITS = re.compile(rf"(?<![\w.])[+(]?\d(?:{_S}?[().\-–/]{{0,2}}{_S}?\d){{5,24}}(?!\d)")
#: Digits and what may stand between those of a number.
_CLUSTER = re.compile(r"\d[\d \t\xa0\r\n().\-–/]{3,}\d")
_CUT = re.compile(r"\s*\n\s*|\s{2,}|/|\)\W+")
_LETTERS_BEFORE = re.compile(r"(?<![^\W\d_])(?:[A-Za-z]{2}\s|[A-Za-z]{1,3})$")
_LETTER_AFTER = re.compile(r"\s?[A-Za-z](?![\w])")
_CODE = re.compile(rf"(?<!\w)[A-Za-z]{{1,3}}\d{{5,10}}[A-Za-z]?(?!\w)|(?<!\w)[A-Za-z]{{2}}(?:{_S}?\d\d){{3}}{_S}?[A-Za-z](?!\w)")
_CODE_END = re.compile(rf"{_S}?[A-Za-z](?!\w)")
#: Words that name a kind of street, box or unit.
STREETS = (
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "court", "ct", "square", "sq", "terrace",
    "crescent", "blvd", "boulevard", "place", "way", "close", "row", "hill", "park", "gardens", "parkway", "circle",
)
_TYPE = "|".join(STREETS)
_UNIT = rf"(?:flat|apt|apartment|suite|unit|room)\.?{_S}\w{{1,5}}"
_HOUSE = r"\d{1,5} ?(?:bis|ter|[a-z])?(?: ?[-–/] ?\d{1,5}(?: ?[a-z])?)?"
_WORDS3 = rf"(?:[nsew]\.?{_S})?[^\W\d_][\w'’\-]*(?:{_S}[^\W\d_][\w'’\-]*){{0,2}}"
_STREET = re.compile(
    rf"(?<![\w.\-])(?:{_UNIT},?{_S})?{_HOUSE},?{_S}{_WORDS3}{_S}(?:{_TYPE})\b\.?(?:,?{_S}{_UNIT})?(?!\w)", re.I
)
_RUE = re.compile(
    rf"(?<![\w.\-])(?:{_UNIT},?{_S})?{_HOUSE},?{_S}(?:rue|avenue|boulevard|place|via|calle|chemin){_S}(?:(?:de|du|des|la|le|del|della|l'|d'){_S}?){{0,2}}[^\W\d_][\w\-]+(?:,?{_S}{_UNIT})?",
    re.I,
)
_CALLE = re.compile(
    rf"(?<!\w)(?:calle|via|plaza|piazza|rua|avenida|viale|corso){_S}(?:(?:de|del|della|dei|da|do|la|las|los){_S}){{0,2}}[^\W\d_][\w'’\-]*(?:{_S}[^\W\d_][\w'’\-]*){{0,2}},?{_S}\d{{1,4}}(?: ?[a-z])?(?!\w)(?:,?{_S}{_UNIT})?",
    re.I,
)
_WEG = re.compile(rf"(?<!\w)[^\W\d_][\w\-]*(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|ring|ufer){_S}\d{{1,4}}(?: ?[a-z])?(?!\w)", re.I)
_BOX = re.compile(rf"(?<!\w)p\.?{_S}?o\.?{_S}?box{_S}\d{{1,6}}(?!\w)|(?<!\w)postfach{_S}\d{{1,6}}(?!\w)", re.I)
_WEG_END = re.compile(r"(?:weg|stra(?:ß|ss)e|str|gasse|platz|allee|ring|ufer)$", re.I)
_TAIL_UNIT = re.compile(rf",?{_S}{_UNIT}$", re.I)
_NEXT_UNIT = re.compile(rf",?{_S}{_UNIT}(?!\w)", re.I)
_HEAD_UNIT = re.compile(rf"^{_UNIT},?{_S}", re.I)
_UNIT_BEFORE = re.compile(rf"{_UNIT},?.$", re.I)

_WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters stay, everything else becomes a blank.
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-–][^\W\d_]+)*\.?|[,(]")
#: Particles of surnames.
PARTICLES = frozenset("van von der den de del della di da du la le el al bin ibn zu ter ten".split())
#: Phrases before which persons are named; they open a search whatever the words look like.
_CUES = re.compile(
    r"(?:(?:signed|read|examined|reviewed|written|cut|reported|told|photographs|admitted)\s+by\s|thank\s|thanks\s+to\s|widow\s+of\s|according\s+to\s"
    r"|(?:sent|requests)\s+to\s|letter\s+from\s|kin:?\s|dear\s|mrs|mr\b\.?|ms\b\.?|miss\s|dr\b\.?|prof|herr\s|frau\s|señora?\s|mme\s|monsieur\s|madame\s|signora?\s|nurse\s|captain\s)",
    re.I,
)
_AND = re.compile(r"\s(?:and|und|et|y|e|&)\s", re.I)
#: Words with which a cue begins; what begins with prof is another.
_CUE_WORDS = frozenset("signed read examined reviewed written cut reported told photographs admitted thank thanks widow according sent requests letter kin dear mrs mr ms miss dr herr frau señor señora mme monsieur madame signor signora nurse captain".split())
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĻĽŁŃŅŇŌŐŒŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΩА-Я"
_CAP = rf"[{_UP}](?:['’][{_UP}])?[^\W\d_{_UP}][^\W\d_]*(?:['’\-–][^\W\d_]+)*"
_PART = rf"(?:{'|'.join(sorted(PARTICLES))})"
#: Runs of capitalised words, initials and particles of two words or more, as "Given I. van Surname" or "Surname, G. I.".
_RUN = re.compile(
    rf"(?<![^\s(\[<\"'“„«;:,/|\ufeff])(?:{_CAP}|[{_UP}]\.?|{_PART}(?={_S}))(?:(?:,?{_S}|(?<=\.))(?:{_CAP}|[{_UP}]\.?(?!\w)|{_PART}(?={_S})|[{_UP}]{{2,3}}(?!\w))){{1,6}}(?![^\s.,;:!?)\]>\"'”“»/|])"
)
_INITIAL = re.compile(r"(?<![\w.])[^\W\d_]\.")
_LONE = r"[^\W\d_]\.?"
_ANY = r"[^\W\d_]{2,}(?:['’\-–][^\W\d_]+)*"
#: Words around initials in text of one case, and two to five words that begin a line or sentence and end at a comma or bracket.
_INITIALS = re.compile(
    rf"(?<![\w.'’\-])(?:(?:{_ANY}{_S})?(?:[^\W\d_]\.{_S}?){{1,3}}(?:{_PART}{_S}){{0,2}}{_ANY}|{_ANY},{_S}(?:{_ANY}{_S})?[^\W\d_]\.(?:{_S}?[^\W\d_]\.)?)(?!\w)", re.I
)
_PART_ANY = "(?:" + "|".join(f(p) for p in sorted(PARTICLES) for f in (str.lower, str.upper, str.capitalize)) + ")"
_PAIR = rf"{_ANY}{_S}(?:(?:{_LONE}|{_PART_ANY}){_S}){{0,3}}{_ANY}"
_LISTED = re.compile(rf"^[ \t\ufeff]*({_PAIR})(?=\s?[,(<:])|^[ \t\ufeff]*({_ANY}[ ][^\W\d_]{{1,3}})(?=[:,])", re.M)
_SENTENCE = re.compile(rf"[.;>)]\s{{1,3}}({_PAIR})(?=\s?[,(<])")
_WHOLE = (_LISTED, _SENTENCE)


_FUNCTION = frozenset(FUNCTION_WORDS) - PARTICLES


def _space(text: str) -> str:
    return " ".join(text.split())


class Lexicon(dict):
    """Class by word: t kind of street, w street name of one word, b box, c word of a cue. A dictionary that fills itself.

    No class depends on a list of names.
    """

    def __init__(self) -> None:
        super().__init__()
        self.tokens, self.bytes = _Tokens(), _Bytes(self)

    def __missing__(self, word: str) -> str:
        low = word.lower()
        if low in _STREET_WORDS:
            known = "t"
        elif len(low) > 5 and _WEG_END.search(low):
            known = "w"
        else:
            known = "b" if low in ("box", "postfach") else "c" if low in _CUE_WORDS or low.startswith("prof") else ""
        if len(self) > 500_000:
            self.clear()
        self[word] = known
        return known

    def marked(self, text: str) -> list[tuple[str, str]]:
        """The words of a text that have a class, once each."""
        if text.isascii():
            found = map(self.bytes.__getitem__, set(text.encode().translate(_LETTERS).split()))
        else:
            found = ((w, self[w]) for w in set(_WORD.findall(text)))
        return [x for x in found if x[1]]


class _Bytes(dict):
    """Words and their classes by their bytes."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> tuple[str, str]:
        if len(self) > 500_000:
            self.clear()
        text = word.decode()
        self[word] = out = (text, self.lexicon[text])
        return out


class _Tokens(dict):
    """Class of a token of a name: an initial, a particle, a short, capitalised or other word."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[w] = out = self.read(w)
        return out

    def read(self, w: str) -> str:
        core = w.rstrip(".")
        if w == ",":
            return ","
        if len(core) == 1:
            return "I." if w.endswith(".") else "I"
        if core.lower() in PARTICLES:
            return "p"
        if len(core) <= 3 and core.isupper():
            return "II"
        return "W" if core[:1].isupper() else "w"


_STREET_WORDS = frozenset((*STREETS, "rue", "via", "calle", "chemin", "plaza", "piazza", "rua", "avenida", "viale", "corso"))


def _numbers(text: str) -> Iterator[Span]:
    """Numbers and codes; both are sought only where digits and their separators stand together."""
    after_digits, after_code = 0, 0
    for cluster in _CLUSTER.finditer(text):
        first, last = cluster.span()
        digits = sum(map(str.isdigit, cluster.group()))
        if digits < 5:
            continue
        if digits > 5:
            at = max(after_digits, first - 1, 0)
            while m := _DIGITS.search(text, at, last + 1):  # what follows the cluster is no digit
                at = after_digits = m.end()
                yield from _readings(text, m)
        if not text[first - 1 : first].isalpha() and not _CODE_END.match(text, last):
            continue
        at = max(after_code, first - 66, 0)
        while (m := _CODE.search(text, at, last + 80)) and m.start() < last:
            at = after_code = m.end()
            yield Span(m.start(), m.end(), "id_number")


def _readings(text: str, m: re.Match) -> Iterator[Span]:
    """Where a number may begin and end."""
    start, end = m.span()
    ends = {end}
    raw = m.group()
    if text[end : end + 1] == ")" and raw.count("(") > raw.count(")"):
        ends.add(end + 1)
    after = _LETTER_AFTER.match(text, end)
    if after:
        ends.add(after.end())
    starts = {start}
    before = _LETTERS_BEFORE.search(text, max(0, start - 4), start)
    if before:
        starts.add(before.start())
    if raw[0] == "(":
        starts.add(start + 1)
        if raw.count(")") == 0:
            starts.discard(start)
    for cut in _CUT.finditer(raw):  # two numbers may stand side by side
        ends.add(start + cut.start())
        starts.add(start + cut.end())
    for a in starts:
        for b in ends:
            if 6 <= sum(c.isdigit() for c in text[a:b]):
                yield Span(a, b, "phone")
                yield Span(a, b, "id_number")


def _addresses(text: str, classes: set[str]) -> Iterator[Span]:
    patterns = [p for c, ps in (("t", (_STREET, _RUE, _CALLE)), ("w", (_WEG,)), ("b", (_BOX,))) if c in classes for p in ps]
    for pattern in patterns:
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span()
            starts, ends = {a}, {b}
            if text[b - 1] == ".":
                ends.add(b - 1)
            if tail := _TAIL_UNIT.search(m.group()):
                ends.add(a + tail.start())
            if head := _HEAD_UNIT.match(m.group()):
                starts.add(a + head.end())
            for x in starts:
                for y in ends:
                    if y - x > 4:
                        yield Span(x, y, "address")
            # the next search may begin inside, at the next number
            inner = _NUMBER_END.search(text, a + 1)
            at = b if pattern in (_WEG, _BOX, _CALLE) or not inner else max(a + 1, min(b, inner.end()))


_NUMBER_END = re.compile(r"\d+\W")


def _whole(text: str, word: str) -> Iterator[int]:
    """Where a word stands by itself."""
    size, at = len(word), text.find(word)
    while at >= 0:
        if not text[at - 1 : at].isalpha() and not text[at + size : at + size + 1].isalpha():
            yield at
        at = text.find(word, at + size)


def _names(text: str, cues: list[str], lexicon: Lexicon) -> Iterator[Span]:
    """Runs of words behind cues, capitalised runs, words around initials, and beginnings of lines and sentences.

    All by shape, whatever the words are, with every plausible beginning and end.
    """
    places: set[int] = set()
    for word in cues:
        for at in _whole(text, word):
            if m := _CUES.match(text, at):
                places.add(m.end())
                if more := _AND.search(text, m.end(), m.end() + 60):  # a second person
                    places.add(more.end())
    seen: set[tuple[int, int]] = set()
    for place in sorted(places):
        tokens = _around(text, place)
        here = next((i for i, t in enumerate(tokens) if t.end() > place), None)
        if here is None:
            continue
        words = [t.group() for t in tokens]
        kinds = [lexicon.tokens[w] for w in words]
        for i in range(here, min(here + 3, len(tokens))):
            if words[i] in ",(":
                continue
            for j in range(i, min(i + NAME_WORDS, len(tokens))):
                last = words[j]
                if last == "(":
                    break
                a, b = tokens[i].start(), tokens[j].end()
                if last.endswith(".") and len(last) > 2:
                    b -= 1
                if last == "," or (a, b) in seen:
                    continue
                seen.add((a, b))
                shape = _shape(kinds[i : j + 1])
                if shape == TOO_LONG:
                    break
                if shape is not None:
                    yield Span(a, b, "name")
    one_case = text.islower() or text.isupper()
    for pattern in (_INITIALS if one_case else _RUN, *_WHOLE):
        if pattern is _INITIALS and not _INITIAL.search(text):
            continue
        for m in pattern.finditer(text):
            tokens = list(_TOKEN.finditer(text, *m.span(m.lastindex or 0)))[: 2 * NAME_WORDS]
            words = [t.group() for t in tokens]
            kinds = [lexicon.tokens[w] for w in words]
            for i in range(len(tokens) - 1):
                # of the beginning of a line or sentence only the whole is a candidate
                for j in range(len(tokens) - 1 if pattern in _WHOLE else i + 1, min(i + NAME_WORDS, len(tokens))):
                    last = words[j]
                    a, b = tokens[i].start(), tokens[j].end()
                    if last.endswith(".") and len(last) > 2:
                        b -= 1
                    if "," in (last, words[i]) or "(" in text[a:b] or (a, b) in seen:
                        continue
                    seen.add((a, b))
                    if _shape(kinds[i : j + 1]) not in (None, TOO_LONG):
                        yield Span(a, b, "name")
                if pattern in _WHOLE:
                    break


TOO_LONG = "-"


def _around(text: str, place: int) -> list[re.Match]:
    """Tokens near a place, up to what ends a name on either side."""
    left = max(0, place - 60)
    out: list[re.Match] = []
    for m in _TOKEN.finditer(text, left, min(len(text), place + 90)):
        if m.start() == left and left and text[left - 1].isalnum():
            continue
        gap = text[out[-1].end() : m.start()] if out else ""
        if out and (gap.strip() or "\n\n" in gap):
            if m.start() > place:
                break
            out = []
        out.append(m)
    return out


def _shape(kinds: list[str]) -> str | None:
    """Classes of a span's words; None if the span cannot be a name."""
    if kinds.count(",") > 1 or kinds.count("w") > 2:
        return TOO_LONG
    if kinds[-1] == "p" or _NAMING.isdisjoint(kinds):
        return None
    return " ".join(kinds)


_NAMING = frozenset(("W", "w"))


def candidates(text: str, lexicon: Lexicon) -> list[Span]:
    """All spans that may be personal information, in order of their end."""
    found: set[Span] = set()
    at = 0
    for sign in _AT_SIGN.finditer(text):
        gap = _GAP_BEFORE.search(text, max(at, sign.start() - 130), sign.start())
        start = gap.start() if gap else sign.start()
        while start > at and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        if m := _EMAIL.match(text, start):
            found.add(Span(m.start(), m.end(), "email"))
            at = m.end()
    found.update(_numbers(text))
    marked = lexicon.marked(text)
    found.update(_addresses(text, {c for _, c in marked}))
    cues = [w for w, c in marked if c == "c" or w.lower() == "dr"]  # dr is a kind of street, too
    found.update(_names(text, cues, lexicon))
    return sorted((s for s in found if s.end - s.start <= LONGEST), key=lambda s: (s.end, s.start, s.kind))


# --- features --------------------------------------------------------------------------------------

_ANY_WORD = re.compile(r"\w+")
_FOLLOW = re.compile(r"(\W*)(\w*)")
_NINES = re.compile("9+")
_PIECES = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_").findall
_DIGIT, _LETTER, _GAP = re.compile(r"\d"), re.compile(r"[^\W\d_]"), re.compile(r"\s+")


def _outline(pieces: list[str]) -> str:
    """Words as a or A, numbers as 9, all else as it is."""
    return "".join(["9" if p[0].isdigit() else ("A" if p[0].isupper() else "a") if p[0].isalpha() else p for p in pieces])


class Context:
    """What stands around the spans of a text; spans share beginnings and ends, so each is looked at once."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text, self.lexicon = text, lexicon
        self.lefts: dict[int, tuple] = {}
        self.rights: dict[int, tuple] = {}

    def word(self, w: str) -> str:
        return "#" if w.isdigit() else w

    def left(self, a: int) -> tuple[str, bool, str, tuple[tuple[str, str], ...]]:
        """The text before, whether it touches, the last word, and the features of it."""
        if a not in self.lefts:
            text = self.text
            before = _GAP.sub(" ", text[max(0, a - 40) : a])
            last = [m.span() for m in _ANY_WORD.finditer(before)][-2:]
            w1 = self.word(before[slice(*last[-1])].lower() if last else "")
            w2 = self.word(before[slice(*last[0])].lower() if len(last) > 1 else "")
            mark = before[last[-1][1] :] if last else before
            at_start = not before.strip() or "\n" in text[max(0, a - 2) : a]
            cue = [m.strip().lower() for m in _CUES.findall(before)][-1:]
            found = (
                ("l1", w1), ("l12", f"{w2} {w1}"), ("lm", mark.strip()[-2:]), ("line", str(at_start)), ("lcue", " ".join(cue)), ("ls", _outline(_PIECES(before)[-6:]))
            )
            self.lefts[a] = before, before[-1:].isalnum(), w1, found
        return self.lefts[a]

    def right(self, b: int) -> tuple[bool, str, tuple[tuple[str, str], ...]]:
        """Whether the text behind touches, the signs before its first word, and the features of it."""
        if b not in self.rights:
            after = _GAP.sub(" ", self.text[b : b + 24])
            follow = _FOLLOW.match(after)
            sep = follow.group(1)[:3]
            self.rights[b] = after[:1].isalnum(), sep, (("r1", sep + self.word(follow.group(2).lower())), ("rm", sep), ("rs", _outline(_PIECES(after)[:6])))
        return self.rights[b]


def features(span: Span, context: Context) -> list[tuple[str, str]]:
    """Features of a whole span beside those of what stands around it: names and values."""
    a, b, kind = span
    text, lexicon = context.text, context.lexicon
    inside = _GAP.sub(" ", text[a:b])
    before, touches, w1, _ = context.left(a)
    touched, sep, _ = context.right(b)
    out = [("bias", ""), ("alnum", str(touches or touched))]
    if kind in ("phone", "id_number"):
        shape = _DIGIT.sub("9", _LETTER.sub("A", inside))
        out += [
            ("shape", shape),
            ("groups", " ".join(str(len(x)) for x in _NINES.findall(shape))),
            ("digits", str(shape.count("9"))),
            ("first", shape[:1]),
            ("seps", "".join(sorted(set(shape) - {"9", "A"}))),
            ("letters", str(shape.count("A"))),
            ("open", str(inside.count("(") == inside.count(")"))),
            ("l1shape", f"{w1}|{shape[:3]}"),
        ]
    elif kind == "name":
        kinds = [lexicon.tokens[t] for t in _TOKEN.findall(text, a, b)]
        shape = _shape(kinds) or "?"
        words = _WORD.findall(inside)
        case = "u" if inside.isupper() else "l" if inside.islower() else "t" if all(w[:1].isupper() or w in PARTICLES for w in words) else "m"
        out += [
            ("shape", shape),
            ("case", case),
            ("n", str(len(kinds))),
            ("shape+l1", f"{shape}|{w1}"),
            ("shape+r", f"{shape}|{sep}"),
            ("comma", str("," in kinds)),
            ("plain", str(kinds.count("W") + kinds.count("w"))),
            ("case+shape", f"{case}|{shape}"),
            ("function", str(min(2, sum(w in _FUNCTION for w in inside.lower().split())))),
            ("dangling", str("I" in kinds or "II" in kinds)),
        ]
        for x in words:
            if len(x) > 1:
                low = x.lower()
                out += [("has_word", low), ("end", low[-3:])]
    elif kind == "address":
        low = inside.lower()
        words = low.replace(",", " ").split()
        shape = " ".join("9" if x[0].isdigit() else x.rstrip(".") if x.rstrip(".") in STREETS or x in _STREET_WORDS or x in ("flat", "apt", "de", "du", "box", "p.o.") else "w" for x in words)
        out += [
            ("shape", shape),
            ("stop", str(inside.endswith("."))),
            ("stop+last", words[-1] if inside.endswith(".") else ""),
            ("case", "u" if inside.isupper() else "l" if inside.islower() else "t"),
            ("n", str(len(words))),
            ("wordcase", str(sum(x[:1].isupper() for x in inside.split()))),
            ("tail_unit", str(bool(_NEXT_UNIT.match(text, b)))),
            ("head_unit", str(bool(_UNIT_BEFORE.search(before)))),
            ("last", words[-1]),
        ]
    else:
        out += [("spaces", str(inside.count(" "))), ("dots", str(inside.count("."))), ("end", str(inside[-1:].isalnum()))]
    return out


def all_features(span: Span, context: Context) -> list[str]:
    """All features of a span by name, prefixed by its kind, as they are learned and stored."""
    found = [*features(span, context), *context.left(span.start)[3], *context.right(span.end)[2]]
    return [f"{span.kind}:{name}={value}" if name != "bias" else f"{span.kind}:bias" for name, value in found]


# --- decoding --------------------------------------------------------------------------------------


def islands(spans: list[Span]) -> Iterator[list[Span]]:
    """Groups of spans that hang together by overlap; spans come ordered by end."""
    order = sorted(spans)
    group: list[Span] = []
    reach = -1
    for s in order:
        if group and s.start >= reach:
            yield sorted(group, key=lambda x: (x.end, x.start, x.kind))
            group = []
        group.append(s)
        reach = max(reach, s.end) if len(group) > 1 else s.end
    if group:
        yield sorted(group, key=lambda x: (x.end, x.start, x.kind))


def best_division(spans: list[Span], scores: list[float]) -> list[Span]:
    """Non-overlapping spans of the greatest total score; the outside scores nothing."""
    ends = [s.end for s in spans]
    best, back = [0.0], [(-1, -1)]
    from bisect import bisect_right

    for i, (span, score) in enumerate(zip(spans, scores)):
        before = bisect_right(ends, span.start, 0, i)
        take = best[before] + score
        if take > best[i]:
            best.append(take)
            back.append((before, i))
        else:
            best.append(best[i])
            back.append((i, -1))
    out, i = [], len(spans)
    while i > 0:
        previous, chosen = back[i]
        if chosen >= 0:
            out.append(spans[chosen])
        i = previous
    return out[::-1]


class Model:
    def __init__(self, weights: dict[str, float], lexicon: Lexicon):
        self.weights, self.lexicon = weights, lexicon
        #: Weights by kind, feature and value, so that scoring builds no names.
        self.tables: dict[str, dict[str, dict[str, float]]] = {kind: {} for kind in KINDS}
        for key, weight in weights.items():
            kind, _, rest = key.partition(":")
            name, _, value = rest.partition("=")
            self.tables[kind].setdefault(name, {})[value] = weight

    def scores(self, text: str, spans: list[Span]) -> list[float]:
        """Scores of spans of a text; what stands around a span is scored once per kind and place."""
        context = Context(text, self.lexicon)
        none: dict[str, float] = {}
        around: dict[tuple[str, str, int], float] = {}
        out = []
        for span in spans:
            table, total = self.tables[span.kind].get, 0.0
            for name, value in features(span, context):
                total += table(name, none).get(value, 0.0)
            for side, place in (("l", span.start), ("r", span.end)):
                key = (span.kind, side, place)
                if key not in around:
                    found = context.left(place)[3] if side == "l" else context.right(place)[2]
                    around[key] = sum(table(name, none).get(value, 0.0) for name, value in found)
                total += around[key]
            out.append(total)
        return out

    def find(self, text: str | None) -> list[Span]:
        """The spans of personal information of a text, in order."""
        if not text:
            return []
        spans = candidates(text, self.lexicon)
        if not spans:
            return []
        score = dict(zip(spans, self.scores(text, spans)))
        out: list[Span] = []
        for group in islands(spans):
            out += best_division(group, [score[s] for s in group])
        return out

    def redact(self, text: str | None) -> str | None:
        """The text with typed placeholders in place of what was found."""
        if not text:
            return text
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def load() -> Model:
    raw = json.loads(resources.files("spanlex.llm").joinpath("models", MODEL).read_text(encoding="utf-8"))
    return Model(raw["weights"], Lexicon())


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, found_text)``, distinct, of every document. The only shuffle is of what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            ids, kinds, found = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, passage in {(s.kind, _space(text[s.start : s.end])) for s in model.find(text)}:
                    ids.append(i)
                    kinds.append(kind)
                    found.append(passage)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(found, pa.string())],
                names=["doc_id", "kind", "found_text"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, found_text string")
    return rows.distinct()


def redact(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with typed placeholders, one row per row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = [model.redact(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")
