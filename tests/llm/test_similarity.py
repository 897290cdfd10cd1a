import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np

from spanlex.llm import buckets, near_duplicates, similar_vectors

T0 = datetime(2024, 1, 1)
VECTORS = "doc_id bigint, vec array<double>, built_at timestamp_ntz, rank int, rep string"


def vectors(seed=1, n=400):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, 64)) * 1.2
    x = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, 64))
    for i in range(0, n, 5):  # near neighbours
        x[i] = x[i - 1] + rng.normal(size=64) * 0.25
    x[300:330] = x[299]  # a group of copies
    return x


def brute(x, k=10):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    return {i: [(j, s[i, j]) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k].tolist()] for i in range(len(x))}


def frame(spark, x):
    rows = [(i, v.tolist(), T0, 1, "r") for i, v in enumerate(x)]
    rows += [(0, x[5].tolist(), T0 - timedelta(days=1), 1, "r"), (1, x[1].tolist(), T0, 1, "r")]
    rows += [(9001, None, T0, 1, "r"), (9002, [0.0] * 64, T0, 1, "r"), (9003, [1.0] * 63, T0, 1, "r"), (9004, [float("nan")] * 64, T0, 1, "r")]
    rows += [(9005, [None] * 64, T0, 1, "r"), (None, x[0].tolist(), T0, 1, "r"), (3, [float("nan")] * 64, T0 + timedelta(days=1), 1, "r")]
    return spark.createDataFrame(rows, VECTORS)


def test_pairs_against_brute_force(spark):
    x = vectors()
    expected = {(min(i, j), max(i, j)) for i, near in brute(x).items() for j, s in near if s >= 0.9}
    got = {tuple(r) for r in similar_vectors.similar_pairs(frame(spark, x)).collect()}
    assert len(expected & got) >= 0.98 * len(expected)
    assert all(i < j for i, j in got)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(u[i] @ u[j] >= 0.9 - 1e-9 for i, j in got)


def test_recall_of_lists(spark):
    x = vectors(2)
    truth = brute(x)
    got = {}
    near = similar_vectors.neighbours(frame(spark, x), asks="doc_id % 10 = 0", tables=6, number=4)
    for r in near.collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    assert set(got) == set(range(0, 400, 10))
    hits = 0.0
    for i, rows in got.items():
        assert [rank for rank, _, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and i not in [n for _, n, _ in rows]
        least = truth[i][-1][1] - 1e-9  # equal similarities at the end are as good
        hits += sum(s >= least for _, _, s in rows) / 10
    assert hits / len(got) >= 0.9
    assert similar_vectors.neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def hits(spark, x, step, **how):
    """Recall of the lists of every step-th vector, against brute force."""
    got = {}
    table = spark.createDataFrame([(i, v.tolist(), T0, 1, "r") for i, v in enumerate(x)], VECTORS)
    for r in similar_vectors.neighbours(table, asks=f"doc_id % {step} = 0", **how).collect():
        got.setdefault(r["doc_id"], []).append(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for i in range(0, len(x), step):
        s = u @ u[i]
        s[i] = -9
        found.append(len(set(np.argsort(-s)[:10].tolist()) & set(got.get(i, []))) / 10)
    return float(np.mean(found))


def test_recall_with_two_hashes(spark):
    """Neighbours at cosines of 0.6 to 0.7, with the tables of a collection above 25,600 vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64))[np.repeat(np.arange(60), 50)] * 1.3 + rng.normal(size=(3000, 64))
    assert similar_vectors.hashes_for(30_000) == 2 and similar_vectors.hashes_for(10**9, most=2) == 2
    assert hits(spark, x, 20, tables=6, number=4, hashes=2, more=16) >= 0.9


def test_recall_is_measured_exactly(spark):
    x = vectors(3, 300)
    one = similar_vectors.recall(frame(spark, x), "doc_id % 10 = 0", tables=6, number=4).first()
    got = {}
    for r in similar_vectors.neighbours(frame(spark, x), asks="doc_id % 10 = 0", tables=6, number=4).collect():
        got.setdefault(r["doc_id"], []).append(r["similarity"])
    truth = brute(x)
    expected = np.mean([sum(s >= truth[i][-1][1] - 1e-8 for s in got.get(i, [])) / 10 for i in range(0, 300, 10)])
    assert one["asked"] == 30 and abs(one["recall"] - expected) < 1e-9 and expected > 0.8


def test_recall_in_a_dense_group(spark):
    """Many distinct vectors of nearly one direction fall into one bucket; none of the nearest is cut."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) + 0.1 * rng.normal(size=(2000, 64))
    assert hits(spark, x, 50, tables=6, number=4) >= 0.97


def test_codes_know_their_error():
    x = np.random.default_rng(7).normal(size=(300, 64)) * np.where(np.arange(300) % 3 == 0, 1, 0.02)[:, None]
    x[:, 5] += 1
    x = similar_vectors.unit(x).astype(np.float32)
    value, error = similar_vectors.bounds(similar_vectors.eight_bits(x), similar_vectors.eight_bits(x))
    assert (np.abs(value - x.astype(float) @ x.T.astype(float)) <= error).all() and error.max() < 0.1


def test_probes_are_the_likeliest_of_all_combinations():
    rng = np.random.default_rng(5)
    x = similar_vectors.unit(rng.normal(size=(20, 8))).astype(np.float32)
    turns = similar_vectors.signs(1, 2, 8)[0]
    got = similar_vectors.probes(x, turns, 12)
    for row, places in zip(x, got):
        loss = {}
        turned = []
        for rounds in turns:
            y = row[None]
            for flip in rounds:
                y = similar_vectors.hadamard(y * flip)
            turned.append(y[0])
        for i in range(8):
            for j in range(8):
                place = (i * 2 + (turned[0][i] > 0)) * 16 + j * 2 + (turned[1][j] > 0)
                loss[place] = sum(np.abs(t).max() - abs(t[k]) for t, k in zip(turned, (i, j)))
        expected = sorted(loss.values())[:12]
        assert len(set(places.tolist())) == 12
        assert np.allclose([loss[p] for p in places.tolist()], expected, atol=1e-5)


def test_large_buckets_of_rows_that_only_store(spark):
    """Rows that only store count for the size of a bucket, and are divided and found like others."""
    rows = [(7, 2 if i % 10 else 0, i, bytes(4)) for i in range(200)] + [(7, 1, 500, bytes(4))]
    table = buckets.written(spark.createDataFrame(rows, buckets.SCHEMA), "t")
    split = buckets.split_large(table, limit=16)
    assert split.where("kind <> 1").groupBy("block").count().agg({"count": "max"}).first()[0] < 60
    got = {tuple(r) for r in buckets.candidates(table, *same_bytes(), 4, limit=16).collect()}
    expected = {(min(i, j), max(i, j)) for i in range(0, 200, 10) for j in range(200) if i != j} | {(i, 500) for i in range(200)}
    assert got == expected


def same_bytes():
    """Functions that travel to the tasks by value."""
    return lambda a, b: (a[:, None, :] == b[None, :, :]).sum(axis=2).astype(np.float32), lambda a, b: (a == b).sum(axis=1)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    y = similar_vectors.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), atol=1e-5)
    assert np.allclose(similar_vectors.hadamard(y), x, atol=1e-5)


def test_large_buckets_lose_nothing(spark):
    """All rows in one bucket, far above the limit: every pair is still found."""
    n = 120
    rows = [(7, 0, i, bytes([i % 3] * 4)) for i in range(n)] + [(7, 1, 500, bytes([1] * 4))] + [(8, 0, 900, bytes(4)), (8, 0, 901, bytes(4))]
    table = buckets.written(spark.createDataFrame(rows, buckets.SCHEMA), "t")
    got = {tuple(r) for r in buckets.candidates(table, *same_bytes(), 4, limit=16).collect()}
    expected = {(i, j) for i in range(n) for j in range(i + 1, n) if i % 3 == j % 3} | {(i, 500) for i in range(n) if i % 3 == 1} | {(900, 901)}
    assert got == expected


def texts():
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ne", "ri", "to", "ka", "lu") for b in ("mar", "gen", "sol", "tin", "pel", "dor", "wick")]
    common = "the of and in was to a with".split()
    base = [[r.choice(words) if r.random() < 0.6 else r.choice(common) for _ in range(r.randint(25, 90))] for _ in range(60)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(r.randint(0, 3)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 9))):
                k = r.randrange(len(c))
                c[k : k + 1] = r.choice(([], [c[k], r.choice(words)], [c[k] + "x"]))
            if r.random() < 0.4:
                r.shuffle(c)
            out.append(" ".join(c).upper() if r.random() < 0.2 else ",\r\n".join(c))
    return [*out, "", None, "too short", "  ", *[out[0]] * 12, "y " * 30_000, "y " * 30_001, "!!! ???"]


def test_near_duplicates_against_brute_force(spark):
    import re

    rows = [(i, t, 1, "z") for i, t in enumerate(texts())]
    bags = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t, _, _ in rows}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= 20}
    expected = set()
    for i in bags:
        for j in bags:
            if i < j:
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both) - 1e-9:
                    expected.add((i, j))
    rows += [rows[3], (None, rows[0][1], 1, "z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, rep int, kind string")
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in near_duplicates.near_duplicate_pairs(table).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= expected
    assert len(got) >= 0.99 * len(expected)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates.near_duplicate_pairs(empty).count() == 0


def some_bags(texts, least=1):
    return near_duplicates.Bags(texts, least)


def test_samples_agree_with_weighted_similarity():
    words = [f"w{i}" for i in range(80)]
    bags = some_bags([" ".join(words[:60]), " ".join(words[20:])])
    s = near_duplicates.signatures(bags, np.ones(near_duplicates.CELLS, dtype=np.float32), 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.04


def test_bags_hold_the_words_of_whole_texts():
    import re

    given = [None, "", "One two; TWO_3 \x01 x\x01y", "Straße–Über, İstanbul “été” naïve", "a" * 70000, "… – !!", "Ω ω Σ ς ß"]
    bags = some_bags(given)
    expected = [Counter(re.findall(r"\w+", (t or "").lower())) for t in given]
    assert bags.kept.tolist() == [i for i, b in enumerate(expected) if b]
    for place, s, size in zip(bags.kept, bags.slices(), bags.size):
        b = expected[place]
        hashed = sorted((near_duplicates._HASHES[w], n) for w, n in b.items())
        assert list(zip(bags.words[s].tolist(), bags.counts[s].tolist())) == hashed and size == sum(b.values())


def test_pairs_at_the_threshold_whatever_their_words_weigh():
    """Pairs of similarity 0.8 share the lightest words and differ in the heaviest ones: bands and code find 99 in 100."""
    d = near_duplicates
    bands, rows = d.banding(1000)
    samples, found, n = bands * rows, 0, 600
    texts = []
    for p in range(n):
        shared = [f"s{p}x{i}" for i in range(80)]
        texts += [" ".join([*shared, *(f"{side}{p}x{i}" for i in range(10))]) for side in "ab"]
    light = {d._HASHES[f"s{p}x{i}"] for p in range(n) for i in range(80)}
    weight = np.full(d.CELLS, d.HEAVY, dtype=np.float32)
    weight[d.cell_of(np.array(sorted(light), dtype=np.uint64))] = d.LIGHT
    bags = some_bags(texts)
    values = d.signatures(bags, weight, samples)
    code = d.code_of(values, bags.size)
    agree = d.Agreement(samples, 0.8)
    near = agree.pairs(code[0::2], code[1::2])
    banded = (values[0::2] == values[1::2]).reshape(n, bands, rows).all(axis=2).any(axis=1)
    found = banded & (near >= d.floor_of(samples))
    assert found.mean() >= 0.985  # 0.99 within the error of 600 pairs
    assert (agree.all(code[:20], code[:20]) == np.array([[agree.pairs(code[i : i + 1], code[j : j + 1])[0] for j in range(20)] for i in range(20)])).all()
    # the same recall for collections of any size
    for texts in (1, 10**6, 10**9, 10**12):
        b, r = d.banding(texts)
        assert (1 - d.worst(0.8) ** r) ** b <= d.MISS


def test_classes_hold_all_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(7000, "a b c", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, links string")
    pairs = [(r["doc_id_a"], r["doc_id_b"]) for r in near_duplicates.near_duplicate_pairs(table).collect()]
    got = {r["doc_id"]: r for r in near_duplicates.classes(table).collect()}
    assert set(got) == {x for p in pairs for x in p}
    partners = Counter(x for p in pairs for x in p)
    for i, r in got.items():
        linked = {got[y]["class_id"] for x, y in pairs + [(b, a) for a, b in pairs] if x == i} - {r["class_id"]}
        assert r["links"] == len(linked) and partners[i] == r["copies"] - 1 + sum(got[c]["copies"] for c in linked)
    assert near_duplicates.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_document_of_several_texts(spark):
    t = texts()
    rows = [(1, t[0]), (1, t[7]), (2, t[0]), (3, t[0]), (4, t[7] + " more"), (5, t[7])]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 4), (1, 5), (4, 5)}


def test_large_groups_of_copies_lose_nothing(spark):
    members = spark.createDataFrame([(0, i) for i in range(50)] + [(60, 60), (60, 61)], "rep bigint, doc_id bigint")
    got = [(r["x"], r["y"]) for r in near_duplicates.copies_of(members, 7).collect()]
    assert sorted(got) == [(i, j) for i in range(50) for j in range(i + 1, 50)] + [(60, 61)]


def test_every_member_of_divided_groups(spark):
    members = spark.createDataFrame([(0, i) for i in range(60)] + [(70, 70), (70, 71)], "rep bigint, doc_id bigint")
    rows = spark.createDataFrame([(0, 1.0), (70, 0.9), (99, 0.5)], "a bigint, s double")
    got = sorted(map(tuple, buckets.every_member(rows, "a", *buckets.in_parts(members, 7)).select("a", "s").collect()))
    assert got == [(i, 1.0) for i in range(60)] + [(70, 0.9), (71, 0.9), (99, 0.5)]


def test_rows_of_buckets_are_bounded_for_any_number_of_texts(spark, monkeypatch):
    """As many bands as ten million texts need: codes stay short, bands come in rounds, and the pairs are the same."""
    d = near_duplicates
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string")
    few = {tuple(r)[:2] for r in d.near_duplicate_pairs(table).collect()}
    monkeypatch.setattr(d, "banding", lambda total, threshold=0.8: (59, 9))
    widths, rounds = [], []
    candidates = buckets.candidates

    def seen(rows, *how):
        widths.append(len(rows.first()["code"]))
        rounds.append(rows.groupBy("id").count().agg({"count": "max"}).first()[0])
        return candidates(rows, *how)

    monkeypatch.setattr(buckets, "candidates", seen)
    many = {tuple(r)[:2] for r in d.near_duplicate_pairs(table).collect()}
    assert max(widths) <= 44 and max(rounds) <= d.ROUND and sum(rounds) == 59
    assert len(many & few) >= 0.99 * len(few) and len(many - few) <= 0.01 * len(few) + 1


def test_samples_are_the_same_in_parts(monkeypatch):
    bags = some_bags(["one two three four five", "two three three six"])
    weight = np.ones(near_duplicates.CELLS, dtype=np.float32)
    whole = near_duplicates.signatures(bags, weight, 150)
    monkeypatch.setattr(near_duplicates, "SAMPLES", 40)
    assert (near_duplicates.signatures(bags, weight, 150) == whole).all()
