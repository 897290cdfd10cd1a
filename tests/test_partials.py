import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanlex.operators import partials

SCHEMA = "run_id int, doc_id bigint, seg int, term string, tf bigint, loaded_at timestamp_ntz, extra string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    best = {}
    for _, doc, seg, term, tf, at, _ in rows:
        if term is None or not term.strip(" ") or tf is None or tf < 1 or doc is None:
            continue
        key = (doc, seg, term.strip(" ").lower())
        value = (at or datetime.min, tf)
        best[key] = max(best.get(key, (datetime.min, 0)), value)
    out = defaultdict(Counter)
    for (doc, _, term), (_, tf) in best.items():
        out[term][doc] += tf
    return out


def sample(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        term = "hot" if r.random() < 0.35 else r.choice(["a", " a", "B ", "b", "c", None, "", "  ", "Ärzte", f"t{r.randint(0, 40)}"])
        rows.append((
            1, r.choice([r.randint(1, 30), r.randint(1, 30), None]) if r.random() < 0.02 else r.randint(1, 30),
            r.choice([0, 1, 2, None]), term, r.choice([1, 1, 2, 3, 0, -1, None]),
            None if r.random() < 0.05 else T0 + timedelta(hours=r.randint(0, 30)), "x",
        ))
    # rows equal in the time are equal in tf
    seen = {}
    out = []
    for row in rows:
        key = (row[1], row[2], (row[3] or "").strip().lower(), row[5])
        tf = seen.setdefault(key, row[4])
        out.append((*row[:4], tf, *row[5:]))
    return out + out[:200]


@pytest.mark.parametrize("most", [None, 40])
def test_top_document_and_totals(spark, most):
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    got = {r["term"]: (r["doc_id"], r["tf"]) for r in partials.top_document(frame, most).collect()}
    assert got == {t: (lambda d, n: (d, n))(*min(c.items(), key=lambda x: (-x[1], x[0]))) for t, c in expected.items()}
    got = {r["term"]: (r["df"], r["cf"], r["max_tf"]) for r in partials.term_totals(frame, most).collect()}
    assert got == {t: (len(c), sum(c.values()), max(c.values())) for t, c in expected.items()}
    plain = defaultdict(Counter)
    for r in partials.current(frame).collect():
        plain[r["term"]][r["doc_id"]] += r["tf"]
    assert plain == expected


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert partials.top_document(frame).count() == 0
    assert partials.term_totals(frame).count() == 0


def test_extreme_numbers(spark):
    """Ids and frequencies beyond the packed range take the wide path and mix with the others."""
    big = 1 << 62
    rows = [
        (1, big, 0, "x", 5, T0, ""), (1, big - 1, 0, "x", 5, T0, ""), (1, 7, 0, "x", 4, T0, ""),
        (1, -5, 0, "y", 2, T0, ""), (1, 3, 0, "y", 2, T0, ""), (1, 9, 0, "z", 1 << 40, T0, ""), (1, 8, 0, "z", 3, T0, ""),
        (1, big, 0, "w", 1, T0, ""), (1, 4, 0, "w", 6, T0, ""),
    ]
    got = {r["term"]: (r["doc_id"], r["tf"]) for r in partials.top_document(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"x": (big - 1, 5), "y": (-5, 2), "z": (9, 1 << 40), "w": (4, 6)}


def test_heavy_terms_are_divided(spark):
    """A term of a third of all rows is spread, the rows of one of its documents stay together, and nothing is lost."""
    rows = [(1, d, 0, "Hot " if d % 2 else "hot", 1 + d % 5, T0, "") for d in range(3000)] + [(1, d, 1, f"t{d}", 1, T0, "") for d in range(6000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    heavy = {r["term"]: r["salts"] for r in partials.heavy_terms(partials.usable(frame), 48).collect()}
    assert set(heavy) == {"hot"} and 16 <= heavy["hot"] <= 18
    parts = partials.salted(frame, 48).where("term = 'hot'").groupBy("salt").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert len(parts) == heavy["hot"] and sum(r["n"] for r in parts) == 3000 and all(r["n"] == r["d"] < 300 for r in parts)
    assert {r["term"]: r["df"] for r in partials.term_totals(frame, 48).collect()}["hot"] == 3000


def test_plan_has_one_wide_shuffle(spark, small):
    frame = partials.top_document(spark.read.parquet(f"{small}/postings.parquet"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by (term, salt), then the partials by term
    assert "hashpartitioning(term" in plan and "salt" in plan
    assert "PushedFilters: [IsNotNull" in plan
