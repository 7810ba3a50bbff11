import random

import pytest
from pyspark.ml.linalg import Vectors

from veilgrove.operators import cluster as C
from veilgrove.operators import graph as G
from veilgrove.storage import cut


def test_x_means_has_no_limit_by_default(spark):
    rng = random.Random(1)
    rows = [(k, Vectors.dense([100.0 * (k % 24) + rng.random(), rng.random()])) for k in range(24 * 5)]
    got = C.x_means(spark.createDataFrame(rows, ["vec_id", "features"]), cut, seed=1)
    assert got.select("cluster").distinct().count() > 20


def test_louvain_raises_at_a_bound(spark):
    e = spark.createDataFrame([(k + 1, k, 1.0) for k in range(12)], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        G.louvain(e, cut, sweeps=1, local=0)


def test_louvain_both_ways(spark):
    """Four cliques in a ring; the distributed sweeps and the moves in order find them."""
    pairs = [(8 * c + a, 8 * c + b, 1.0) for c in range(4) for a in range(8) for b in range(a)] + [(8 * ((c + 1) % 4), 8 * c + 7, 1.0) for c in range(4)]
    e = spark.createDataFrame([(max(a, b), min(a, b), w) for a, b, w in pairs], "src long, dst long, w double")
    want = {n: n // 8 * 8 for n in range(32)}
    assert {r.node: r.comm for r in G.louvain(e, cut).collect()} == want
    assert {r.node: r.comm for r in G.louvain(e, cut, local=0).collect()} == want
