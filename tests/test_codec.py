import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlex.functions import codec as C

IDS, TFS = [34, 67, 89, 454, 2345738], [12, 10, 3, 4, 1]


@pytest.mark.parametrize(
    "name, ids, numbers, expected",
    [
        ("vbe", True, IDS, "a2a19602ed010f12c4"),
        ("vbe", False, TFS, "8c8a838481"),
        ("optpfordelta", True, IDS, "000000050000000e090501110842d6d000010f12c484"),
        ("optpfordelta", False, TFS, "0000000500000006040500ca3410"),
    ],
)
def test_golden_bytes(name, ids, numbers, expected):
    assert C.encode(numbers, name, ids).hex() == expected


def test_standard_size():
    assert len(C.encode(IDS, "standard", True)) == 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), unique=True, max_size=400), st.lists(st.integers(0, 2**40), max_size=400))
def test_round_trip(ids, tfs):
    for name in C.CODECS:
        assert C.decode(C.encode(sorted(ids), name, True), name, True) == sorted(ids)
        assert C.decode(C.encode(tfs, name, False), name, False) == tfs


def test_large_gaps():
    r = random.Random(5)
    ids, at = [], 0
    for _ in range(500):
        at += r.randint(1, 100)
        ids.append(at)
    ids[-2] = ids[-3] + 1500
    ids[-1] = ids[-2] + 2**20
    for name in C.CODECS:
        assert C.decode(C.encode(ids, name, True), name, True) == ids


def test_refusals():
    with pytest.raises(ValueError):
        C.encode([3, 2], "vbe", True)
    with pytest.raises(ValueError):
        C.encode([1], "zip", True)
    with pytest.raises(ValueError):
        C.decode(b"", "zip", True)


def test_lists_in_parts(spark, monkeypatch):
    """Lists that go through many ranges of ids and many parts: places, gaps, bytes and numbers are those of whole lists."""
    from pyspark.sql import functions as F

    from spanlex.operators import index

    monkeypatch.setattr(index, "RANGE_BITS", 5)
    monkeypatch.setattr(index, "PART", 2 * C.BLOCK)
    r = random.Random(3)
    lists = {"hot": list(range(0, 3000, 2)), "one": [7], "far": sorted(r.sample(range(10**9), 400)), "full": list(range(256)), "last": list(range(5, 5 + 257))}
    tfs = {t: [r.choice([1, 1, 2, 700, 10**6]) for _ in ids] for t, ids in lists.items()}
    rows = [(t, d, f) for t, ids in lists.items() for d, f in zip(ids, tfs[t])]
    r.shuffle(rows)
    postings = spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint")
    parts = index.posting_parts(postings)
    whole = {x["term"]: (x["doc_ids"], x["tfs"]) for x in index.posting_lists(postings).collect()}
    assert whole == {t: (ids, tfs[t]) for t, ids in lists.items()}
    assert parts.agg(F.max(F.size("doc_ids"))).first()[0] == 2 * C.BLOCK
    for name in C.CODECS:
        encoded = index.encode_parts(parts, name)
        got = {}
        for x in encoded.orderBy("term", "part").collect():
            a, b = got.get(x["term"], (b"", b""))
            got[x["term"]] = a + bytes(x["postings"]), b + bytes(x["tfs"])
        assert got == {t: (C.encode(ids, name, True), C.encode(tfs[t], name, False)) for t, ids in lists.items()}
        assert sorted(map(tuple, index.decode_parts(encoded).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        index.encode_parts(parts, "zip")
