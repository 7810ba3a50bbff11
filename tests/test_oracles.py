"""Every query with an oracle agrees with it on the smallest tables; all others run."""

import glob
import math
import os

import duckdb
import pytest

from veilgrove import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    order = [names.index(n) for n in sorted(names)]
    tidy = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=lambda t: [(x is not None, x if x is not None else 0) for x in t])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
