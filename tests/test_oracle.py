"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os
from collections import Counter

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*" if os.path.isdir(f"{DATA}/{f}") else "")
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def names():
    from hopframe.plans.registry import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from hopframe.plans.registry import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    there = [d[0] for d in cur.description]
    assert sorted(there) == columns
    at = [there.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    found, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60
    df = e.entry(spark)
    assert df.columns == ["q", "passage", "score", "rank", "how"]
