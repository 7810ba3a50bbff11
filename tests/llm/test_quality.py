import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrove.llm import quality as Q

WORDS = "the of and to river stone bird wind moon tree road song night day rain snow with for that".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.15
        w = [rng.choice(WORDS) for _ in range(rng.randint(40, 120))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["blarg", "snurf"])
        t = " ".join(x + "###" for x in w) if bad else " ".join(w) + "."
        out.append((i, t, f"h{i % 7}", "en" if i % 3 else "fr", int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(600), "doc_id long, text string, source string, lang string, quality int, toxic int")
    return df, Q.fit(df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic"))


def test_held_out_accuracy(spark, fitted):
    _, model = fitted
    assert {b"blarg", b"snurf"} <= model.lexicon
    held = spark.createDataFrame(corpus(400, 2), "doc_id long, text string, source string, lang string, quality int, toxic int")
    got = Q.classify(held, model, F.col("source"), F.col("lang")).collect()
    assert len(got) == 400
    assert np.mean([r.kept == (r.quality == 1 and r.toxic == 0) for r in got]) > 0.97


def test_posteriors_against_plain_sums(spark, fitted):
    df, model = fitted
    scored = Q.evidence(df.withColumns({"_host": F.col("source"), "_path": F.col("lang")}), model).select("_host", "_path", "doc_prob")
    rows = scored.collect()
    got = {(r._host, r._path): (r.host_posterior, r.path_posterior) for r in Q.sites(scored).collect()}
    mean = np.mean([r.doc_prob for r in rows])

    def prior(groups):
        n = sum(len(v) for v, _ in groups)
        dev = sum(len(v) * (np.mean(v) - c) ** 2 for v, c in groups)
        return Q.strength(mean, max(0.0, (dev - (len(groups) - 1) * mean * (1 - mean)) / n))

    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r._host, []).append(r.doc_prob)
        paths.setdefault((r._host, r._path), []).append(r.doc_prob)
    k = prior([(v, mean) for v in hosts.values()])
    post = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k2 = prior([(v, post[h]) for (h, _), v in paths.items()])
    for (h, p), v in paths.items():
        assert np.allclose(got[h, p], (post[h], (sum(v) + k2 * post[h]) / (len(v) + k2)), atol=1e-6)


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 500 + [("low", "a", 0.1)] * 500 + [("one", "a", 0.1), ("mid", "a", 0.6), ("mid", "a", 0.4)]
    got = {r._host: r.host_posterior for r in Q.sites(spark.createDataFrame(rows, "_host string, _path string, doc_prob double")).collect()}
    assert abs(got["big"] - 0.9) < 0.01 and abs(got["low"] - 0.1) < 0.01
    assert got["one"] > 0.15  # one row moves a site less than five hundred do


def test_strength():
    assert Q.strength(0.5, 0.05) == pytest.approx(4.0)
    assert Q.strength(0.5, 0.0) == 10_000 and Q.strength(None, None) == 10_000 and Q.strength(0.5, 0.9) == 2.0


def test_nulls_clashes_and_no_labels(spark, fitted):
    df, model = fitted
    odd = spark.createDataFrame([(1, None, None, None, "x"), (None, "", "", "", "y"), (2, "the of and " * 9000, "h1", None, "z"), (2, "the of and " * 9000, "h1", None, "z")], "doc_id long, text string, source string, lang string, posterior string")
    got = Q.classify(odd, model, F.col("source"), F.col("lang"))
    assert got.columns == ["doc_id", "text", "source", "lang", *Q.RESULTS] and got.count() == 4
    none = Q.fit(odd, spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"))
    assert all(r.kept for r in Q.classify(odd, none, F.col("source"), F.col("lang")).collect())
    assert Q.classify(odd.limit(0), model, F.col("source"), F.col("lang")).count() == 0
