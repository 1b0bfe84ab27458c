"""Training-data queries with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["op1_page_text", "op2_minhash_dedup", "op7_repeated_passages"])
def test_query(spark, name):
    import duckdb

    from hopframe.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = Counter(cur.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()) == want
