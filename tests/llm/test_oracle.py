"""Queries of this subpackage that SQL can express agree with it."""

import os

import duckdb
import pytest

from veilgrove.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(map(tuple, df.collect())) == want
