import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from spanlex.llm import registry
from spanlex.llm.term_frequency import counters, term_frequencies
from spanlex.llm.top_n import top_n

T0 = datetime(2024, 1, 1)
RESULTS = "qid string, rank int, doc_id bigint, doc_name string, score double, shard int, scored_at timestamp_ntz, sub string"
POSTINGS = "run_id int, doc_id bigint, seg int, term string, tf bigint, loaded_at timestamp_ntz, records string"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(same, name):
    same(name)


def test_top_n_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for _ in range(2500):
        q = "hot" if r.random() < 0.4 else r.choice(["a", "b", None, "c"])
        d = r.choice([None, *range(400)]) if r.random() < 0.1 else r.randint(0, 400)
        score = r.choice([None, math.nan, 0.0, -0.0, 1.0, 1.0, 2.5, -3.0, r.random()])
        rows.append((q, None, d, None if r.random() < 0.03 else f"n{(d or 0) % 90}", score, 0, None if r.random() < 0.05 else T0 + timedelta(hours=r.randint(0, 9)), "s"))
    rows += rows[:300]
    best = {}
    for q, _, d, n, s, _, at, _ in rows:
        if s is None or math.isnan(s):
            continue
        value = (at or datetime.min, s + 0.0, n is not None, n or "")
        best[q, d] = max(best.get((q, d), value), value)
    groups = defaultdict(list)
    for (q, d), (_, s, has, n) in best.items():
        groups[q].append((s, has, n, d is not None, d or 0))
    got = defaultdict(list)
    for x in top_n(spark.createDataFrame(rows, RESULTS), 10).orderBy("rank").collect():
        got[x["qid"]].append((x["score"], x["doc_name"] is not None, x["doc_name"] or "", x["doc_id"] is not None, x["doc_id"] or 0))
    assert {q: v for q, v in got.items()} == {q: sorted(v, reverse=True)[:10] for q, v in groups.items()}


def test_top_n_empty_and_refusal(spark):
    assert top_n(spark.createDataFrame([], RESULTS)).count() == 0
    with pytest.raises(ValueError):
        top_n(spark.createDataFrame([], RESULTS), 0)


def test_marks(spark):
    rows = [(1, d, 0, " The ", 2, T0, "x") for d in range(8)]
    rows += [(1, d, 0, "two", 1, T0, "x") for d in (1, 2)] + [(1, d, 0, "mid", 1, T0, "x") for d in (1, 2, 3)]
    rows += [(1, 1, 0, "the", 5, T0 + timedelta(hours=1), "x"), (1, 9, 0, None, 1, T0, "x"), (1, 9, 0, "zero", 0, T0, "x")]
    rows += [(1, 1, None, "two", 1, T0, "x"), (1, 1, 0, "two", 1, T0, "x")]
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(spark.createDataFrame(rows, POSTINGS)).collect()}
    assert got == {"the": (19, 8, "common"), "two": (3, 2, "rare"), "mid": (3, 3, None)}
    assert term_frequencies(spark.createDataFrame([], POSTINGS)).count() == 0


def test_counters_hold_the_last_record(spark):
    """Salted counters of a heavy term add up to its records, each of which is in one of them."""
    rows = [(1, d, s, "hot", 1 + s, T0, "x") for d in range(200) for s in (0, 1)] + [(1, d, 0, f"t{d}", 1, T0, "x") for d in range(400)]
    frame = spark.createDataFrame(rows, POSTINGS)
    got = [r for r in counters(frame, 24).where("term = 'hot'").collect()]
    assert len(got) > 5 and sum(r["records"] for r in got) == 200 and sum(r["occurrences"] for r in got) == 600
    assert max(r["last_record"] for r in got) == 199 and all(r["records"] < 60 for r in got)
    plain = {r["term"]: tuple(r) for r in term_frequencies(frame).collect()}
    assert {r["term"]: tuple(r) for r in term_frequencies(frame, most=24).collect()} == plain and plain["hot"][1:] == (600, 200, None)
