import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(small):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(small).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, small, tables):
    """Compares a query with its SQL, as bags of rows."""
    from collections import Counter

    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()

    def value(v):
        return round(v, 5) if isinstance(v, float) else v

    def check(name):
        frame = queries[name](spark, small)
        columns = sorted(frame.columns)
        got = Counter(tuple(value(r[c]) for c in columns) for r in frame.select(*columns).collect())
        result = tables.execute(sql[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        expected = Counter(tuple(value(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert got == expected

    return check
