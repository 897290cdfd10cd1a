import heapq
import math
import random

import pytest

from spanlex.operators import evaluate, krylov, lsi, retrieve
from spanlex.operators.index import build, merge_postings, posting_lists, vocabulary

TOY = [(1, "d1", "x", "apple apple banana"), (2, "d2", "y", "banana cherry"), (3, "d3", "x", "apple"), (4, "d4", "y", ""), (5, "d5", "y", None)]


def toy(spark, method="spimi"):
    return build(spark.createDataFrame(TOY, "doc_id bigint, doc_name string, block string, text string"), method=method)


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, text string")


def found(frame):
    return [(r["doc_name"], r["score"]) for r in frame.orderBy("qid", "rank").collect()]


def test_toy_scores(spark):
    index = toy(spark)
    q = asked(spark, "apple banana")
    assert found(retrieve.retrieve(index, q, "tfidf")) == [("d1", 1.091977), ("d3", 0.405465), ("d2", 0.405465)]
    assert found(retrieve.retrieve(index, q, "bm25")) == [("d1", 0.831445), ("d3", 0.527105), ("d2", 0.405465)]
    q = asked(spark, "apple apple zzz")
    assert found(retrieve.retrieve(index, q, "tfidf")) == [("d1", 1.373024), ("d3", 0.81093)]
    assert found(retrieve.retrieve(index, q, "bm25")) == [("d3", 1.054209), ("d1", 1.004009)]


def test_nothing_found_and_bad_k(spark):
    index = toy(spark)
    for method in ("tfidf", "bm25", "bm25_wand"):
        assert retrieve.retrieve(index, asked(spark, "zzz", "", None), method).count() == 0
        with pytest.raises(ValueError):
            retrieve.retrieve(index, asked(spark, "apple"), method, k=0)
    with pytest.raises(ValueError):
        retrieve.retrieve(index, asked(spark, "apple"), "other")


def test_statistics_and_empty_collection(spark):
    assert toy(spark).corpus_stats.first().asDict() == {"n": 3, "avdl": 2.0, "min_dl": 1}
    empty = build(spark.createDataFrame([], "doc_id bigint, doc_name string, block string, text string"))
    assert empty.corpus_stats.first().asDict() == {"n": 0, "avdl": None, "min_dl": 1}
    assert retrieve.retrieve(empty, asked(spark, "apple")).count() == 0


def test_block_build_is_the_same(spark):
    key = lambda i: sorted(map(tuple, i.postings.select("doc_id", "term", "tf").collect()))
    assert key(toy(spark)) == key(toy(spark, "bsbi"))
    with pytest.raises(ValueError):
        toy(spark, "other")


def test_merge_example(spark):
    frame = lambda rows: spark.createDataFrame([("t", *r) for r in rows], "term string, doc_id bigint, tf bigint")
    merged = merge_postings(frame([(1, 34), (3, 2), (4, 23)]), frame([(1, 11), (2, 4), (4, 3), (6, 13)]))
    lists = posting_lists(merged).first()
    assert list(zip(lists["doc_ids"], lists["tfs"])) == [(1, 45), (2, 4), (3, 2), (4, 26), (6, 13)]


def test_dense_ids(spark):
    got = {r["term"]: r["term_id"] for r in vocabulary(toy(spark).postings).collect()}
    assert got == {"apple": 0, "banana": 1, "cherry": 2}


def cursor_wand(scores, k):
    """Document-at-a-time heap over exact bounds: the procedural model of the admission rule."""
    heap = []
    for doc, name, score in sorted(scores):
        threshold = heap[0][0] if len(heap) == k else 0
        if score <= threshold:
            continue
        if len(heap) < k:
            heapq.heappush(heap, (score, name))
        else:
            heapq.heapreplace(heap, (score, name))
    return sorted(heap, reverse=True)


def test_wand_admission(spark):
    r = random.Random(4)
    rows, expected, k = [], {}, 3
    for q in range(150):
        scores = [(d, f"n{r.randint(0, 99)}-{d}", float(r.randint(0, 4))) for d in range(r.randint(1, 9))]
        expected[str(q)] = cursor_wand(scores, k)
        rows += [(str(q), d, n, s) for d, n, s in scores]
    frame = spark.createDataFrame(rows, "qid string, doc_id bigint, doc_name string, score double")
    got = {}
    for row in retrieve.top_k(retrieve.admit(frame, k), k).orderBy("qid", "rank").collect():
        got.setdefault(row["qid"], []).append((row["score"], row["doc_name"]))
    assert {q: got.get(q, []) for q in expected} == expected


@pytest.mark.parametrize("held, cells", [(10**6, 8_000_000), (5, 60)])
def test_blocks_equal_joins(spark, monkeypatch, held, cells):
    """Block-wise scoring gives the rows of the joins, with many ties, zero weights, small blocks and early cuts."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    docs = [(d, f"n{r.randint(0, 40):02d}" if d % 7 else None, "b", " ".join(["all", *(r.choice(words) for _ in range(r.choice([2, 2, 3, 6])))])) for d in range(220)]
    index = build(spark.createDataFrame(docs, "doc_id bigint, doc_name string, block string, text string"))
    q = asked(spark, "w1 w2 w2", "all", "all w3", "zzz", "w4 w5 w6 w7 all all", "w8", "", None)
    monkeypatch.setattr(retrieve, "HELD", held)
    monkeypatch.setattr(retrieve, "CELLS", cells)
    for method in ("tfidf", "bm25", "bm25_wand"):
        for k in (1, 4, 300):
            rows = lambda: sorted((x["qid"], x["rank"], x["score"], x["doc_name"] or "") for x in retrieve.retrieve(index, q, method, k).collect())  # noqa: B023, E731
            blocks = rows()
            monkeypatch.setattr(retrieve, "QUERY_ROWS", 0)
            assert blocks == rows() and blocks
            monkeypatch.setattr(retrieve, "QUERY_ROWS", 2_000_000)


def test_metrics(spark):
    frame = spark.createDataFrame([("q", i + 1, rel) for i, rel in enumerate([1, 0, 1, 1, 0])], "qid string, rank int, rel int")
    value = lambda name: evaluate.metric(frame, name).first()["value"]
    assert value("rbp") == pytest.approx(0.4304)
    assert value("DCG") == pytest.approx(1.930677, abs=1e-6)
    assert value("ndcg") == pytest.approx(0.906025, abs=1e-6)
    assert value("AP") == pytest.approx(0.483333, abs=1e-6)
    nothing = spark.createDataFrame([("q", 1, 0)], "qid string, rank int, rel int")
    assert evaluate.metric(nothing, "NDCG").first()["value"] is None
    with pytest.raises(ValueError):
        evaluate.metric(frame, "MRR")


def test_lsi_equals_dense_algebra(spark, monkeypatch):
    import numpy as np

    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(d, f"n{d:02d}", "b", " ".join(r.choice(words) for _ in range(12))) for d in range(20)]
    index = build(spark.createDataFrame(docs, "doc_id bigint, doc_name string, block string, text string"))
    model = lsi.build(index, 6)
    text = "w1 w2 w2 w3 w9"
    got = {x["doc_name"]: x["score"] for x in lsi.retrieve(index, model, asked(spark, text), 20).collect()}
    tf = np.array([[t[3].split().count(w) for t in docs] for w in words], dtype=float)
    df = (tf > 0).sum(axis=1)
    idf = np.where(df > 0, np.log(len(docs) / np.maximum(df, 1)), 0)
    damp = lambda x: np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0)
    a = idf[:, None] * damp(tf)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    u, s, vt = u[:, :6], s[:6], vt[:6]
    q = idf * damp(np.array([text.split().count(w) for w in words], dtype=float))
    folded = q @ u / s
    vectors = vt.T * s
    cosine = vectors @ folded / np.linalg.norm(vectors, axis=1) / np.linalg.norm(folded)
    for (_, name, _, _), c in zip(docs, cosine):
        assert got[name] == pytest.approx(c, abs=1e-5)
    big = lsi.build(index, 6) if not monkeypatch.setattr(krylov, "CELLS", 50) else None  # ranges of a few columns
    assert np.allclose(big.sigma, model.sigma)
    monkeypatch.setattr(lsi, "CELLS", 12)
    monkeypatch.setattr(retrieve, "HELD", 3)
    again = {x["doc_name"]: x["score"] for x in lsi.retrieve(index, big, asked(spark, "zzz", text, "w1"), 20).where("qid = '1'").collect()}
    assert again.keys() == got.keys() and all(abs(again[n] - got[n]) < 2e-6 for n in got)
    few = lsi.retrieve(index, big, asked(spark, "zzz", text, "w1"), 3).where("qid = '1'").orderBy("rank").collect()
    assert [x["doc_name"] for x in few] == sorted(got, key=lambda n: (-got[n], n))[:3]
    assert model.k == 6 and math.isclose(model.sigma[0], s[0], rel_tol=1e-9)


def test_decomposition_of_a_larger_matrix(spark):
    """Many steps, a rank below the number of rows, and an empty matrix."""
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.where(rng.random((300, 220)) < 0.08, rng.normal(size=(300, 220)) ** 2, 0.0)
    a[:, 0] += 0.5
    a[250:] = a[:50]
    rows = [(i * 7 - 50, np.flatnonzero(x).tolist(), x[x != 0].tolist()) for i, x in enumerate(a)]
    table = spark.createDataFrame(rows, "doc_id bigint, t array<int>, w array<double>").repartition(5)
    found = krylov.decompose(table, 220, 12)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(found.sigma, s[:12], rtol=1e-7) and found.residual < 1e-6
    v = np.array([r["v"] for r in found.vectors.orderBy("doc_id").collect()])
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-6)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", v, u[:, :12])), 1, atol=1e-5)
    low = spark.createDataFrame([(i, [0, 1], [1.0, float(i % 2)]) for i in range(40)], "doc_id bigint, t array<int>, w array<double>")
    assert len(krylov.decompose(low, 2, 10).sigma) == 2
    empty = build(spark.createDataFrame([], "doc_id bigint, doc_name string, block string, text string"))
    assert lsi.retrieve(empty, lsi.build(empty), asked(spark, "apple")).count() == 0


def test_measured_rankings_are_those_of_retrieve(spark, small, monkeypatch):
    """Metrics found in groups of few queries and blocks of few postings, against those of the written rankings."""
    from spanlex.operators import evaluate, measure
    from spanlex.plans import entries

    index, queries, qrels = entries.built(spark, small), entries.asked(spark, small), entries.table(spark, small, "qrels")
    monkeypatch.setattr(measure, "HITS", 300)
    methods = ("tfidf", "bm25", "bm25_wand")
    for k in (5, 1000):
        monkeypatch.setattr(measure, "ROWS", 30 * k)
        got = {(r["method"], r["qid"]): r for r in measure.measured(index, queries, qrels, methods, k).collect()}
        for method in methods:
            judged = evaluate.judge(retrieve.retrieve(index, queries, method, k), qrels).persist()
            for name in evaluate.METRICS:
                expected = {r["qid"]: r["value"] for r in evaluate.metric(judged, name).collect()}
                mine = {q: r[name] for (m, q), r in got.items() if m == method}
                assert set(mine) == set(expected)
                assert all(x == expected[q] or abs(x - expected[q]) < 1e-9 for q, x in mine.items())


def test_steps_leave_nothing_behind(spark, monkeypatch):
    """X'Y in many ranges: rows are written once a step, and only the singular vectors stay on disk."""
    import os

    import numpy as np

    x = np.random.default_rng(3).random((50, 40)) * (np.random.default_rng(4).random((50, 40)) < 0.4)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "doc_id bigint, t array<int>, w array<double>")
    written = []
    durable = krylov.durable
    monkeypatch.setattr(krylov, "durable", lambda df, what: written.append(durable(df, what)) or written[-1])
    monkeypatch.setattr(krylov, "CELLS", 13 * 10)
    found = krylov.decompose(table, 40, 5)
    assert np.allclose(found.sigma, np.linalg.svd(x, compute_uv=False)[:5], atol=1e-6)
    sizes = [len(r["v"]) for r in found.vectors.collect()]
    assert sizes == [5] * 50
    left = [t for t in written if os.path.exists(t._spanlex_path)]
    assert len(left) == 1 and left[0]._spanlex_path == found.vectors._spanlex_path
    assert not [p for p in os.listdir(os.path.dirname(found.vectors._spanlex_path)) if p.startswith("ranges")]


def test_measured_lsi_rankings_are_those_of_retrieve(spark, small, monkeypatch):
    """Metrics found group by group of queries in blocks of few documents, against those of the written rankings."""
    from spanlex.operators import evaluate, measure
    from spanlex.plans import entries

    index, queries, qrels = entries.built(spark, small), entries.asked(spark, small), entries.table(spark, small, "qrels")
    model = lsi.build(index, 9)
    monkeypatch.setattr(measure, "CELLS", 90)  # ten queries a round
    for k in (5, 1000):
        got = {r["qid"]: r for r in measure.measured_lsi(index, model, queries, qrels, k).collect()}
        judged = evaluate.judge(lsi.retrieve(index, model, queries, k), qrels).persist()
        for name in evaluate.METRICS:
            expected = {r["qid"]: r["value"] for r in evaluate.metric(judged, name).collect()}
            assert set(got) == set(expected)
            assert all(r[name] == expected[q] or abs(r[name] - expected[q]) < 1e-9 for q, r in got.items())


def test_space_of_a_decomposition_is_bounded(spark, monkeypatch):
    """Slowly falling singular values take many steps; the vectors held per row stay few, and values that repeat are all found."""
    import numpy as np

    rng = np.random.default_rng(5)
    a = np.where(rng.random((260, 240)) < 0.1, rng.random((260, 240)), 0.0)
    rows = [(i, np.flatnonzero(x).tolist(), x[x != 0].tolist()) for i, x in enumerate(a)]
    seen, advance = [], krylov._advance
    monkeypatch.setattr(krylov, "_advance", lambda parts, blocks, total, *rest: seen.append(total) or advance(parts, blocks, total, *rest))
    found = krylov.decompose(spark.createDataFrame(rows, "doc_id bigint, t array<int>, w array<double>").coalesce(1), 240, 20)
    assert np.allclose(found.sigma, np.linalg.svd(a, compute_uv=False)[:20], rtol=1e-7)
    assert max(seen) <= max(50, 24 + 2 * 8) and len(seen) > 6
    same = spark.createDataFrame([(i, [i], [2.0 if i < 30 else 1.0]) for i in range(60)], "doc_id bigint, t array<int>, w array<double>").coalesce(1)
    assert np.allclose(krylov.decompose(same, 60, 20).sigma, [2.0] * 20)


def test_terms_of_one_document_need_no_column(spark, monkeypatch):
    import numpy as np

    r = random.Random(7)
    docs = [(d, f"n{d:02d}", "b", " ".join([*(r.choice("abcdefgh") * 2 for _ in range(9)), *(f"own{d}x{i}" for i in range(d % 4))])) for d in range(24)]
    index = build(spark.createDataFrame(docs, "doc_id bigint, doc_name string, block string, text string"))
    columns, decompose = [], lsi.decompose
    monkeypatch.setattr(lsi, "decompose", lambda rows, number, k: columns.append(number) or decompose(rows, number, k))
    model = lsi.build(index, 10)
    words = sorted({w for t in docs for w in t[3].split()})
    tf = np.array([[t[3].split().count(w) for t in docs] for w in words], dtype=float)
    a = np.log(len(docs) / (tf > 0).sum(axis=1))[:, None] * np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0)
    assert np.allclose(model.sigma, np.linalg.svd(a, compute_uv=False)[:10], rtol=1e-7)
    assert columns == [sum((tf > 0).sum(axis=1) > 1)] and columns[0] < len(words)


def test_scores_of_some_queries_are_taken():
    """Queries that a block can't serve are left out of it, and keep their floor."""
    import numpy as np
    import pyarrow as pa

    none = np.empty(0, dtype=np.int64)
    task = retrieve._Task(retrieve.Batch(["a", "b", "c"], none, none, none, []), 1, False, -np.inf)
    ids, names = np.array([1, 2]), pa.array(["y", "x"])
    task.take(np.array([[0.1, 0.2], [0.9, 0.3], [0.5, 0.4]]), ids, names, np.arange(3))
    task.take(np.array([[0.7, 0.6], [0.1, 0.8]]), ids + 2, names, np.array([0, 2]))
    assert task.least.tolist() == [0.7, 0.9, 0.8]
    task.cut()
    q, found, _, scores = task.joined()
    assert sorted(zip(q.tolist(), found.tolist(), scores.tolist())) == [(0, 3, 0.7), (1, 1, 0.9), (2, 4, 0.8)]
