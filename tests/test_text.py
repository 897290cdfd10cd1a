import re

import pytest

from spanlex.functions.stemmer import IRREGULAR, stem
from spanlex.functions.text import term_rows, tokens

CASES = ["don't well-known café STRASSE ß 12_3", "a\r\nb\n\nc", "", "  ", "the and of", None, "x" * 100_000 + " y"]


def test_tokens_match_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id bigint, text string")
    for r in rows.select("text", tokens("text").alias("w")).collect():
        assert r["w"] == (None if r["text"] is None else re.findall(r"\w+", r["text"].lower()))


def test_stopwords_and_stems(spark):
    rows = spark.createDataFrame([(1, "The running of the runs"), (2, "the of"), (3, None)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in term_rows(rows, ["doc_id"], stop=True, stem=True).collect()}
    assert got == {(1, "run"): 2}


@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"),
        ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"),
        ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("is", "is"), ("a", "a"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_modes_differ_and_table():
    assert stem("dies", "extended") == "die" and stem("dies", "original") == "di"
    assert all(stem(w) == s for w, s in IRREGULAR.items())
