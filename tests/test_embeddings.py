from veilgrove.queries import io, models

D = "/root/testdata/sf0.001"


def test_queries_read_all_dimensions(spark):
    vf = io._small(spark, D)
    assert [(f.name, f.party_id) for f in vf.features] == [(f"e{k}", int(k >= 32)) for k in range(64)]
    assert models._vectors(spark, D).first().features.size == 64
    got = models.forest_nodes(spark, D)
    assert got.where("feature >= 8").count() > 0
