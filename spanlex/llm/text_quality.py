"""Per-document text quality statistics, and learned rules that tell running text from everything else.

Input is ``documents(doc_id, text)``; ``common_words(word)`` for the share of common words. All
statistics are column expressions over the whole text, without a shuffle. Defined results:

* a null text has null statistics and is no case; an empty or blank one has zero counts and null shares;
* ``n_chars`` counts characters that are not white space; a line is what stands between line ends (CR, LF or
  CRLF) and isn't blank; a word is a maximal run of letters, digits and underscores of the lower-cased text;
* a line ends in punctuation if its last non-blank character is one of ``. ! ? : ;``;
* ``running`` is the share of the text's characters in lines (of a longer line each sentence by itself) of which
  at least ``LINE_SHARE`` of the words are function words of some language, white space but tabs left out;
* ``echoing`` is the same share, where besides the listed ones a text's own function words count: short words it
  repeats, of which a line of letters has to hold two at least. So it is open to languages nobody listed, and
  to scripts that put no blanks between words. Repeated rows of a document come out repeated.

Rules are learned by incremental reduced-error pruning on labelled documents (``quality_training``), ordered,
and stored as conditions on the statistics; they run as one SQL CASE expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French, Spanish, Italian, Dutch and Portuguese.
FUNCTION_WORDS = tuple(
    """
    the of and in was to a with is by were that for it on as at this been from an be which has had are or but not
    these who than their its we have they after before during between into under when there also may can all
    some most other others no so because if while through without against about
    der die das und des den dem ein eine einer eines einem einen im zu zur zum mit von vom bei auf aus nach
    über war wurde wurden ist sind nicht auch es sich für als wie daß dass kam werden hat haben hatte durch
    weder noch
    le la les un une du de et en au aux dans par pour sur avec que qui ne pas est sont été ont avait ce cette ces
    il elle se plus ou chez parmi ni sans
    el los las una del y con para no fue fueron ha han su sus más entre sin sobre tras lo al cuando
    di della dei che non una sono stato il het een van met voor niet zijn werd o os da do em um uma com não foi
    """.split()
)
LINE_SHARE = 0.2
#: Letters of the short words that are looked for again in a text.
SHORT = 3
#: Letters among the characters of a line that may be running by the text's own short words.
LETTERS = 0.85
#: A line longer than this is judged sentence by sentence.
LONG_LINE = 200
FEATURES = (
    "running", "echoing", "repeated_short", "distinct_share", "function_share", "digit_ratio", "symbol_ratio", "mean_word", "words_per_line",
    "punct_lines", "letter_ratio", "mean_gap",
)
MODEL = "quality_rules.json"

# Everything but letters, digits and the underscore; ASCII is decided first, which is most of the work.
_WORDS = r"[\x00-/:-@\[-^`{-\x7f[^\x00-\x7f\p{L}\p{N}]]+"
_NO_LETTERS = r"[\x00-@\[-`{-\x7f[^\x00-\x7f\p{L}]]+"
_NO_DIGITS = r"[\x00-/:-\x7f[^\x00-\x7f\p{N}]]+"
_SPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
_STOPS = r"[\u3001\u3002\uff01\uff0c\uff0e\uff1f\u104b\u17d4]|[\p{IsThai}\p{IsLao}]{20}"
_TRAILING = " \t\x0b\x0c"
_BLANK = r"[\s\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _is_function(word: Column) -> Column:
    return word.isin(*dict.fromkeys(FUNCTION_WORDS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _is_short(word: Column) -> Column:
    return (F.length(word) <= SHORT) & (word != "") & (F.translate(word, "0123456789_", "") == word)


def _own(short: Column) -> Column:
    """The short words, given in order, that a text repeats."""
    return F.array_distinct(F.filter(short, lambda w, i: (i > 0) & (w == F.get(short, i - 1))))


def _judged(text: Column) -> Column:
    """Characters, words and function words of every part of a text with its own words, and its kind.

    1 is a running part by listed words, 2 one by the text's own or by its script, 0 any other.
    """
    counted = F.transform(
        text["c"],
        lambda x: F.struct(
            x.alias("x"),
            (F.size(x["w"]) - (x["w"][0] == "").cast("int") - ((F.size(x["w"]) > 1) & (F.element_at(x["w"], -1) == "")).cast("int")).alias("words"),
            # a single letter in front is the mark of an item
            F.size(F.filter(x["w"], lambda w, i: _is_function(w) & ((i > (x["w"][0] == "").cast("int")) | (F.length(w) > 1)))).alias("hits"),
        ),
    )

    def kind(p: Column) -> Column:
        n, part, own = p["x"]["n"], p["x"]["p"], text["own"]
        listed = (p["hits"] >= LINE_SHARE * p["words"]) & (p["words"] >= 3)
        echo = (
            (p["words"] >= 5)
            & (F.size(own) >= 2)
            & (F.size(F.filter(p["x"]["w"], lambda w: F.array_contains(own, w))) >= LINE_SHARE * p["words"])
            & (F.size(F.array_intersect(p["x"]["w"], own)) >= 2)
            & (F.length(F.regexp_replace(part, _NO_LETTERS, "")) >= LETTERS * n)
        )
        # scripts without blanks between words: a line with a mark of a sentence, mostly of such letters
        dense = (n >= 8) & (p["words"] * 3 <= n) & part.rlike(_STOPS) & (2 * F.length(F.regexp_replace(part, _SPACED, "")) >= n)
        return F.when(listed, 1).when(echo | dense, 2).otherwise(0)

    return F.transform(counted, lambda p: F.struct(p["x"]["n"].alias("n"), p["words"].alias("words"), p["hits"].alias("hits"), kind(p).alias("kind")))


def _counts(words: Column, short: Column, common_words: list[str] | None) -> list[Column]:
    """Distinct words of a text, letters of all, repetitions of short ones, and common words; empty words are between others."""
    return [
        F.size(F.array_remove(F.array_distinct(words), "")).alias("n_distinct"),
        F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        (F.size(short) - F.size(F.array_distinct(short))).alias("repeated"),
        (F.size(F.filter(words, lambda w: w.isin(*common_words))) if common_words else F.lit(None).cast("int")).alias("common"),
    ]


def statistics(docs: DataFrame, common_words: list[str] | None = None, full: bool = True) -> DataFrame:
    """One row of statistics per row of ``docs``, with ``doc_id``; those on distinct and common words only if ``full``."""
    text = F.col("text")
    parts = F.expr(
        r"flatten(transform(split(lower(text), '\r\n|\r|\n'), l -> "
        rf"if(length(l) > {LONG_LINE}, split(l, '(?<=[.!?;])\\s+'), array(l))))"
    )
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda l: F.rtrim(l, F.lit(_TRAILING))), lambda l: l != "")
    # each step is evaluated once: what is used twice is bound by a step of its own, and only small values leave it
    cut = F.transform(parts, lambda p: F.struct(p.alias("p"), F.length(F.replace(p, F.lit(" "), F.lit(""))).alias("n"), F.split(p, _WORDS).alias("w")))
    def judge(c: Column, words: Column, short: Column) -> Column:
        whole = _counts(words, short, common_words) if full else []
        return _let(F.struct(c.alias("c"), _own(short).alias("own")), lambda t: F.struct(_judged(t).alias("parts"), *whole))

    judged = _let(cut, lambda c: _let(F.flatten(c["w"]), lambda ws: _let(F.array_sort(F.filter(ws, _is_short)), lambda short: judge(c, ws, short))))
    second = docs.select(
        "doc_id",
        F.regexp_replace(text, _BLANK, "").alias("solid"),
        lines.alias("lines"),
        judged.alias("j"),
    )
    second = second.withColumn("parts", F.col("j.parts"))
    add = lambda acc, x: acc + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    third = second.select(
        "doc_id",
        F.length("solid").alias("n_chars"),
        total(F.transform("parts", lambda p: p["words"])).alias("n_words"),
        F.size("lines").alias("n_lines"),
        *[(F.col(f"j.{c}") if full else F.lit(None).cast("int")).alias(c) for c in ("n_distinct", "word_chars", "repeated", "common")],
        total(F.transform("parts", lambda p: p["n"])).alias("part_chars"),
        total(F.transform("parts", lambda p: F.when(p["kind"] == 1, p["n"]).otherwise(0))).alias("running_chars"),
        total(F.transform("parts", lambda p: F.when(p["kind"] > 0, p["n"]).otherwise(0))).alias("echo_chars"),
        total(F.transform("parts", lambda p: p["hits"])).alias("hits"),
        F.length(F.regexp_replace("solid", _NO_DIGITS, "")).alias("digits"),
        F.length(F.regexp_replace("solid", _NO_LETTERS, "")).alias("letters"),
        F.size(F.filter("lines", lambda l: F.right(l, F.lit(1)).isin(*".!?:;"))).alias("ended"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return third.select(
        "doc_id",
        "n_chars",
        "n_words",
        "n_lines",
        share("word_chars", "n_words").alias("mean_word"),
        share("common", "n_words").alias("common_share"),
        share("hits", "n_words").alias("function_share"),
        share("running_chars", "part_chars").alias("running"),
        share("echo_chars", "part_chars").alias("echoing"),
        share("repeated", "n_words").alias("repeated_short"),
        share("digits", "n_chars").alias("digit_ratio"),
        share("letters", "n_chars").alias("letter_ratio"),
        F.try_divide(
            (F.col("n_chars") - F.col("digits") - F.col("letters")).cast("double"), F.col("n_chars").cast("double")
        ).alias("symbol_ratio"),
        share("ended", "n_lines").alias("punct_lines"),
        share("n_words", "n_lines").alias("words_per_line"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_chars", "n_words").alias("mean_gap"),
    )


def load_rules() -> list[list[tuple[str, str, float]]]:
    """The stored ordered rules: each a list of (statistic, operator, threshold)."""
    raw = json.loads(resources.files("spanlex.llm").joinpath("models", MODEL).read_text())
    return [[tuple(c) for c in rule] for rule in raw["rules"]]


def _needs_all() -> bool:
    """Whether a rule uses statistics on distinct words."""
    return any(name in ("distinct_share", "repeated_short", "common_share", "mean_word") for rule in load_rules() for name, _, _ in rule)


def case_expression(rules: list[list[tuple[str, str, float]]]) -> str:
    """Ordered rules as SQL: the number of the first rule that holds, 0 if none does."""
    arms = []
    for i, rule in enumerate(rules, 1):
        conditions = " and ".join(f"{name} {op} {float(value)!r}D" for name, op, value in rule)
        arms.append(f"when {conditions} then {i}")
    return "case " + " ".join(arms) + " else 0 end" if arms else "0"


def not_running(docs: DataFrame, least_chars: int = 80) -> DataFrame:
    """``(doc_id, rule)`` of the documents that are mostly no running text, with the rule that says so."""
    stats = statistics(docs, full=_needs_all()).fillna(0.0, subset=list(FEATURES))
    row = F.struct("doc_id", "n_chars", F.expr(case_expression(load_rules())).alias("rule"))
    # a filter would be pushed below the projections and evaluate the statistics again for each condition;
    # it can't pass a generator
    rows = stats.select(F.explode(F.array(row)).alias("x")).select("x.doc_id", "x.n_chars", "x.rule")
    return rows.where((F.col("n_chars") >= least_chars) & (F.col("rule") > 0)).select("doc_id", "rule")
