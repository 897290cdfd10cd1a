"""Training of the text quality rules: labelled documents, rule induction, export.

    python -m spanlex.llm.quality_training

Labelled documents are drawn from a generator (bounded by ``DOCUMENTS``): invented words put into sentences
of several languages, and into the tables, lists, directories, menus and noise that a collection carries,
in all line layouts; mixtures are labelled by which part is larger. One third is for pruning, and a further
set for measuring.
"""

from __future__ import annotations

import json
import random
import string
from pathlib import Path

import numpy as np

from spanlex.llm.text_quality import FEATURES, MODEL

DOCUMENTS = 6000

LANGUAGES = (
    "the of and in was to a with is by were that for it on as at been from which has had are not these".split(),
    "der die das und des den dem ein eine in mit von bei nach wurde ist nicht es sich für auf im war kam".split(),
    "le la les des du de et en dans une un par pour est sont a été que qui ne pas ce cette chez avec sur".split(),
    "el la los las de del y en con para una un no se ha fue que por al su es tras sin más".split(),
    "di la il che e non per una in con del della sono è stato nella dei le un da".split(),
    "de het een van en in met voor niet zijn werd op te dat was bij door".split(),
)


#: Letters of invented languages, by script: none of them has a listed function word but by chance.
SCRIPTS = ("aeiouyåäöøæbdfghjklmnprstv", "aeiouąęóybcdłńprsśtwzźżk", "аеиоуыэюябвгдзйклмнпрстхчш", "αεηιουωβγδκλμνπρστφχ", "اويبتثجحدرسشعفقكلمن", "אבגדהוזחטיכלמנסעפצקרשת")


class Language:
    """An invented language: a script, short words that come again and again, and longer ones."""

    def __init__(self, r: random.Random):
        self.letters = r.choice(SCRIPTS)
        own = lambda low, high: "".join(r.choice(self.letters) for _ in range(r.randint(low, high)))
        self.short = [own(1, 3) for _ in range(r.randint(8, 22))]
        self.parts = [own(1, 3) for _ in range(30)]

    def word(self, r: random.Random) -> str:
        return "".join(r.choice(self.parts) for _ in range(r.randint(2, 5)))

    def text(self, r: random.Random, size: int) -> str:
        share, out = r.uniform(0.28, 0.5), []
        while sum(map(len, out)) < size:
            n = r.randint(7, 24)
            words = [r.choice(self.short[: r.randint(3, len(self.short))]) if r.random() < share else self.word(r) for _ in range(n)]
            words[r.randrange(n)] += ","
            out.append(" ".join(words).capitalize() + r.choice("...!?"))
        return " ".join(out)


def word(r: random.Random) -> str:
    return "".join(r.choice(("ba", "ne", "ri", "to", "lus", "gen", "mo", "ka", "pel", "dra", "os", "in", "e", "st")) for _ in range(r.randint(2, 5)))


def sentence(r: random.Random, language: list[str], share: float) -> str:
    n = r.randint(7, 28)
    words = [r.choice(language) if r.random() < share else (str(r.randint(1, 400)) if r.random() < 0.05 else word(r)) for _ in range(n)]
    for _ in range(r.randint(0, 2)):
        words[r.randrange(n)] += ","
    return " ".join(words).capitalize() + "."


def prose(r: random.Random, size: int) -> str:
    if r.random() < 0.06:  # a script without blanks
        signs = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(150)]
        clause = lambda: "".join(r.choice(signs) for _ in range(r.randint(4, 16)))
        text = "".join(clause() + r.choice("\uff0c\uff0c\u3002") for _ in range(size // 10)) + "\u3002"
        return "\n".join(text[i : i + 40] for i in range(0, len(text), 40)) if r.random() < 0.4 else text
    if size > 300 and r.random() < 0.35:
        text = Language(r).text(r, size)
        return wrapped(r, text) if r.random() < 0.6 else text
    language, share = r.choice(LANGUAGES), r.uniform(0.33, 0.6)
    out: list[str] = []
    while sum(map(len, out)) < size:
        out.append(sentence(r, language, share))
    text = "  ".join(out) if r.random() < 0.3 else " ".join(out)
    if r.random() < 0.3:
        text = text.replace(".", " .").replace(",", " ,")
    if r.random() < 0.6:
        text = wrapped(r, text)
    k = r.random()
    return text.lower() if k < 0.3 else text.upper() if k < 0.4 else text


def wrapped(r: random.Random, text: str) -> str:
    width, lines, line = r.randint(45, 80), [], ""
    for w in text.split(" "):
        if len(line) + len(w) + 1 > width:
            lines.append(line.ljust(width) if r.random() < 0.2 else line)
            line = ""
        line = f"{line} {w}" if line else w
    return r.choice(("\n", "\r\n")).join([*lines, line])


def value(r: random.Random) -> str:
    return r.choice(("-", "+", "++", "n.d.", str(r.randint(1, 900)), f"{r.random() * 9:.2f}±{r.random():.2f}", f"{r.random() * 99:.1f}"))


def name(r: random.Random) -> str:
    return f"{word(r).capitalize()} {word(r).capitalize()}"


def other(r: random.Random, size: int) -> str:
    """Anything but running text, at least ``size`` characters."""
    kind = r.randrange(20)
    foreign, mark = Language(r), r.choice(("o ", "- ", "* ", "• ", "a ", "e ", "1. "))
    bad = "".join(r.choice("ÃÂâï¿½œ™©°¬ž¢‚") for _ in range(9))
    cols, sep = r.randint(2, 7), r.choice(("\t", " | ", ";", " ", "  "))
    joint = r.choice(("\n", "\r\n"))
    line = {
        0: lambda: sep.join([word(r), *(value(r) for _ in range(cols))]),
        1: lambda: "".join(x.ljust(14) for x in [word(r), *(value(r) for _ in range(cols))]),
        2: lambda: f"{word(r)}{r.choice(('', ' ' + word(r)))}: {value(r)} {r.choice(('mg', 'ml', 'sec', 'per cent', 'mEq/l'))}",
        3: lambda: f"{word(r)} {word(r)}, " + ", ".join(str(r.randint(1, 900)) for _ in range(r.randint(1, 5))),
        4: lambda: f"{name(r)} {r.choice('ABCDE')}: {word(r)} {word(r)}. acta {word(r)} {r.randint(1930, 1975)}; {r.randint(1, 99)}: {r.randint(1, 200)}-{r.randint(200, 900)}",
        5: lambda: f"{name(r)}, {r.choice(('ward', 'room', 'unit'))} {r.randint(1, 30)}, " + r.choice((f"{r.randint(100, 999)}-555-{r.randint(1000, 9999)}", f"{word(r)}@{word(r)}.test", f"{r.randint(1, 300)} {word(r).capitalize()} Road")),
        6: lambda: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)),
        7: lambda: " ".join(f"{r.randrange(256):02x}" for _ in range(16)),
        8: lambda: r.choice("_=~*#-") * r.randint(20, 70) + f" {r.randint(1, 99)}",
        9: lambda: " ".join("".join(r.choice("abcdefgjkrstvxz|#%{}<>=*\\/~") for _ in range(r.randint(2, 10))) for _ in range(9)),
        10: lambda: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 10))) for _ in range(r.randint(5, 12))) + ".",
        11: lambda: " ".join(word(r) if r.random() > 0.05 else r.choice(LANGUAGES[0]) for _ in range(r.randint(6, 14))) + ".",
        12: lambda: ", ".join(f"{word(r)} {word(r)}" if r.random() < 0.5 else word(r) for _ in range(8)) + ",",
        13: lambda: r.choice((" > ", "  ", " | ")).join(r.choice((word(r), "home", "search", "contact", "next page", "help", "top", "print", "login")) for _ in range(9)),
        14: lambda: word(r) if r.random() < 0.6 else f"{word(r)} {word(r)}",
        15: lambda: f"{r.randint(1, 40)}. {word(r)} {r.choice(('of', 'in', 'and', 'by'))} {word(r)} " + "." * r.randint(5, 30) + f" {r.randint(1, 300)}",
        16: lambda: mark + " ".join(word(r) for _ in range(r.randint(1, 3))),
        17: lambda: mark + " ".join(foreign.word(r) for _ in range(r.randint(1, 3))),
        18: lambda: " ".join("".join(r.choice(bad) for _ in range(r.randint(1, 4))) + word(r)[r.randint(0, 3) :] for _ in range(9)),
        19: lambda: sep.join([foreign.word(r), *(value(r) for _ in range(cols))]),
    }[kind]
    rows: list[str] = []
    if r.random() < 0.3:
        rows.append(f"table {r.randint(1, 9)}. {word(r)} of {word(r)} by {word(r)}")
    while sum(map(len, rows)) < size:
        rows.append(line())
    return (" " if kind in (10, 11, 12, 13, 18) and r.random() < 0.7 else joint).join(rows)


def labelled(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts and whether less than half of each is running text."""
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        size, k = r.choice((150, 400, 900, 1800)), r.random()
        if k < 0.4:
            texts.append(prose(r, size))
            labels.append(False)
        elif k < 0.75:
            texts.append(other(r, size))
            labels.append(True)
        else:
            part = r.uniform(0.1, 0.35) if r.random() < 0.5 else r.uniform(0.65, 0.95)
            whole = max(size, 500)
            parts = [(prose(r, int(whole * part)), True), (other(r, int(whole * (1 - part))), False)]
            if r.random() < 0.3:
                parts.reverse()
            solid = {running: sum(not c.isspace() for c in text) for text, running in parts}
            texts.append("\n".join(text for text, _ in parts))
            labels.append(solid[True] < 0.5 * (solid[True] + solid[False]))
    return texts, np.array(labels)


Rule = list[tuple[str, str, float]]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for feature, op, value in rule:
        column = x[:, FEATURES.index(feature)]
        out &= column <= value if op == "<=" else column >= value
    return out


def grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the condition of the largest information gain until no negative is covered."""
    rule: Rule = []
    inside = np.ones(len(x), dtype=bool)
    while (inside & ~y).any() and len(rule) < 6:
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        base, best, choice = np.log2(p / (p + n)), 1e-9, None
        for j, feature in enumerate(FEATURES):
            column = x[inside, j]
            for value in np.unique(np.quantile(column, np.linspace(0.01, 0.99, 60))):
                for op in ("<=", ">="):
                    hit = column <= value if op == "<=" else column >= value
                    a = int((hit & y[inside]).sum())
                    b = int(hit.sum()) - a
                    if a and (gain := a * (np.log2(a / (a + b)) - base)) > best:
                        best, choice = gain, (feature, op, float(value))
        if choice is None:
            break
        rule.append(choice)
        inside &= covers([choice], x)
    return rule


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop final conditions while the share of rightly treated documents of the pruning set doesn't fall."""

    def worth(some: Rule) -> float:
        return float((covers(some, x) == y).mean())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda some: (round(worth(some), 6), -len(some)))


def induce(x: np.ndarray, y: np.ndarray, seed: int = 1, most: int = 12) -> list[Rule]:
    """Incremental reduced-error pruning: grow on two thirds, prune on one, drop what is covered, repeat."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(x), dtype=bool), []
    while (left & y).any() and len(rules) < most:
        part = rng.random(len(x)) < 2 / 3
        a, b = left & part, left & ~part
        if not (a & y).any() or not b.any():
            break
        rule = grow(x[a], y[a])
        if not rule:
            break
        rule = prune(rule, x[b], y[b])
        hit = covers(rule, x[b])
        if hit.sum() == 0 or (hit & ~y[b]).sum() > 0.15 * hit.sum():
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def features(spark, texts: list[str]) -> np.ndarray:
    from spanlex.llm.text_quality import statistics

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = statistics(rows).fillna(0.0, subset=list(FEATURES)).toPandas().sort_values("doc_id")
    return got[list(FEATURES)].to_numpy(dtype=float)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    texts, y = labelled(DOCUMENTS, 1)
    x = features(spark, texts)
    rules = induce(x, y)
    texts, truth = labelled(DOCUMENTS // 3, 2)
    held = features(spark, texts)
    said = np.any([covers(rule, held) for rule in rules], axis=0)
    report = {
        "precision": round(float((said & truth).sum() / max(1, said.sum())), 4),
        "recall": round(float((said & truth).sum() / max(1, truth.sum())), 4),
    }
    target = Path(__file__).parent / "models" / MODEL
    target.write_text(json.dumps({"rules": rules, "held_out": report}, indent=1) + "\n")
    print(json.dumps({"rules": rules, "held_out": report}, indent=1))


if __name__ == "__main__":
    main()
