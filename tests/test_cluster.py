import math
import random

import numpy as np
from pyspark.ml.linalg import Vectors

from veilgrove.operators import cluster as C
from veilgrove.storage import cut


def rows(spark, centres, n, seed=1):
    rng = random.Random(seed)
    out = [(k * n + i, Vectors.dense([c + rng.gauss(0, 1) for c in centre])) for k, centre in enumerate(centres) for i in range(n)]
    return spark.createDataFrame(out, ["vec_id", "features"])


def test_moments_and_likelihood(spark):
    df = rows(spark, [(0, 0, 0)], 60)
    x = np.array([r.features.toArray() for r in df.collect()])
    m = next(iter(C.moments(df.selectExpr("*", "0 AS cluster")).values()))
    assert m.n == 60 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.scatter / 59, np.cov(x.T))
    cov, d = np.cov(x.T), x - x.mean(0)
    want = sum(-0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + v @ np.linalg.inv(cov) @ v) for v in d)
    assert math.isclose(C.log_likelihood(m), want)
    assert C.log_likelihood(C.Moments(3, m.mean, m.scatter)) is None


def test_x_means_finds_the_groups(spark):
    df = rows(spark, [(0, 0), (40, 10), (400, 0), (460, 30)], 40)
    for kw in ({}, {"begin": 2, "splits": C.splits_by_normal_law}):
        got = C.x_means(df, cut, seed=3, **kw).collect()
        assert len({r.cluster for r in got}) == 4 and len({(r.cluster, r.vec_id // 40) for r in got}) == 4


def test_sse_means_and_svd(spark):
    df = rows(spark, [(0, 0), (50, 50)], 30)
    assert C.sse_means(df, 4).select("cluster").distinct().count() in (1, 2, 3)
    x = np.array([r.features.toArray() for r in df.orderBy("vec_id").collect()])
    got = np.array([r.sv for r in C.truncated_svd(df, 2).orderBy("vec_id").collect()])
    _, s, _ = np.linalg.svd(x)
    assert np.allclose(np.linalg.norm(got, axis=0), s)
