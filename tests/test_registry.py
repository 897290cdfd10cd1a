import pytest

import __spark_entry__ as entry
from spanlex.plans import entries, oracle


@pytest.mark.parametrize("name", sorted(set(entries.QUERIES) & set(oracle.ORACLE)))
def test_query_equals_sql(same, name):
    same(name)


def test_every_sql_has_a_query():
    assert set(oracle.ORACLE) <= set(entries.QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["qid", "rank", "doc_id", "doc_name", "score"]
    assert frame.count() > 0
