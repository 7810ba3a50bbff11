import __spark_entry__
from veilgrove import catalogue


def test_every_oracle_has_its_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(catalogue.QUERIES) <= set(queries)


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["party_id", "feature_id", "x", "score"] and df.count() == 4
