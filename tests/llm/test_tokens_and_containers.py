import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanlex.llm import packing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.vocabulary_path()), reason="no vocabulary files")
LETTERS = "ab  \n\t\r 　'stéλ中<|endoftext|>019.,-\x1c\x85​ ﬁ\U0001f600"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_library(plain):
    r = random.Random(1)
    e = tokenizer.encoder(tokenizer.vocabulary_path())
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["ab" * 20_000, " " * 500, "x" + " " * 7 + "\n y", "<|endoftext|>", "it's DON'T"]
    for text in texts:
        assert list(e.encode(text)) == plain(text)


def test_memory_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 5)
    e = tokenizer.Encoder(tokenizer.vocabulary_path())
    text = " ".join(f"word{i} other{i % 7}" for i in range(200))
    assert list(e.encode(text)) == plain(text) and len(e) <= 6


def test_table(spark, plain):
    rows = [(1, "A short text.", 5), (2, "", 5), (3, None, 5), (1, "A short text.", 6), (None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokenizer.encode_documents(frame).collect()))
    assert got == [(0, plain("x")), (1, plain("A short text.")), (1, plain("A short text.")), (2, []), (3, [])]
    counts = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokenizer.count_tokens(frame).collect())
    assert counts == [(0, 1), (1, len(plain("A short text."))), (1, len(plain("A short text."))), (2, 0), (3, 0)]


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.array([0, 1, 0, 2, 0, 0, 3, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    y = packing.nnls(a, -np.ones(20))
    assert (y == 0).all()


@pytest.mark.parametrize("sizes, least", [
    (np.clip(np.random.default_rng(1).normal(350, 120, 20000), 1, 2048).astype(int), 0.99),
    (np.random.default_rng(1).integers(1, 2049, 20000), 0.97),
    (np.r_[np.full(9000, 683), np.random.default_rng(2).integers(50, 900, 18000)], 0.96),
    (np.full(100, 2048), 1.0),
    (np.full(1000, 700), 0.68),
])
def test_plan_is_whole_and_tight(sizes, least):
    from collections import Counter

    histogram = Counter(sizes.tolist())
    patterns = packing.plan(histogram)
    used = Counter()
    for p in patterns:
        assert sum(p.sizes) <= packing.CAPACITY and p.times > 0
        for s in p.sizes:
            used[s] += p.times
    assert used == histogram
    assert sum(sizes) / sum(p.times for p in patterns) / packing.CAPACITY >= least
    assert len(patterns) <= 3 * packing.CAPACITY


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 0, -3, 100, 100, 700, r.randint(1, 2048), 5000])) for i in range(500)] + [(7, 100), (7, 100)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, size bigint")).collect()
    load, pieces = {}, {}
    for x in got:
        load[x["container"]] = load.get(x["container"], 0) + x["n"]
        pieces.setdefault(x["id"], []).append((x["start"], x["n"]))
    assert max(load.values()) <= packing.CAPACITY
    assert sorted(load) == list(range(len(load)))
    for i, size in rows[:500]:
        mine = sorted(pieces.get(i, []))
        if not size or size < 1:
            assert not mine or i == 7
        elif i != 7:
            assert sum(n for _, n in mine) == size
            assert len(mine) == -(-size // packing.CAPACITY)
    assert packing.pack(spark.createDataFrame([], "id bigint, size bigint")).count() == 0
