"""Suffix stripping after Porter (1980), with the usual later amendments as a mode.

``mode="original"`` follows the paper. ``mode="extended"`` (default) adds the amendments that
common toolkits ship: a table of irregular forms, words of at most two letters left alone,
``-ies``/``-ied`` of four-letter words, ``y`` to ``i`` only behind a consonant that is not the
first letter, and the ``fulli``, ``bli``, ``logi`` and ``alli`` rules of step 2.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# The suffix tables of steps 2 to 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as a string of c and v."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str, extended: bool) -> bool:
    shape = _shape(word)
    if shape[-3:] == "cvc" and word[-1] not in "wxy":
        return True
    return extended and len(word) == 2 and shape == "vc"


def _swap(word: str, table, least: int) -> str:
    """Apply the rule of the longest matching suffix, if the rest measures more than ``least``."""
    best = max((r for r in table if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if best is None:
        return word
    stem = word[: len(word) - len(best[0])]
    return stem + best[1] if _measure(stem) > least else word


def _plural(word: str, extended: bool) -> str:
    if extended and len(word) == 4 and word.endswith("ies"):
        return word[:-1]
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + put
    return word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            if _measure(stem) == 1 and _cvc(stem, extended):
                return stem + "e"
            return stem
    return word


def _y_to_i(word: str, extended: bool) -> str:
    if not word.endswith("y"):
        return word
    stem = word[:-1]
    fits = len(stem) > 1 and _shape(stem)[-1] == "c" if extended else _has_vowel(stem)
    return stem + "i" if fits else word


def _step2(word: str, extended: bool) -> str:
    if not extended:
        return _swap(word, STEP2, 0)
    if word.endswith("alli"):
        stem = word[:-4]
        return _step2(stem + "al", extended) if _measure(stem) > 0 else word
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    table = tuple(r for r in STEP2 if r[0] not in ("abli", "alli")) + (("bli", "ble"), ("fulli", "ful"))
    return _swap(word, table, 0)


def _step4(word: str) -> str:
    best = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if best is None:
        return word
    stem = word[: len(word) - len(best)]
    if _measure(stem) <= 1 or (best == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _step5(word: str, extended: bool) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem, extended)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str, mode: str = "extended") -> str:
    """The stem of one lower-case word."""
    extended = mode == "extended"
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _plural(word, extended)
    word = _past(word, extended)
    word = _y_to_i(word, extended)
    word = _step2(word, extended)
    word = _swap(word, STEP3, 0)
    word = _step4(word)
    return _step5(word, extended)


def stem_column(col: Column | str, mode: str = "extended") -> Column:
    """Stems as an Arrow-batched function; meant for a distinct vocabulary, not for every token."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w, mode))

    return run(col)


# The examples published with the algorithm (Porter 1980), word and stem in turn.
EXAMPLES = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll
"""


def examples() -> list[tuple[str, str]]:
    words = EXAMPLES.split()
    return list(zip(words[0::2], words[1::2]))
