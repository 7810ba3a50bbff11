import random
import re

import numpy as np
import pytest
import xxhash

from veilgrove.llm import simhash


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(d, low.get(root(i), d))
    return [low[root(i)] for i in range(len(ids))]


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("abC Dé\n\t\x0b\x1c\xa0") for _ in range(rng.choice([0, 3, 40, 400])))
        assert simhash.fingerprint(t) == brute_fingerprint(t), repr(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 6])
def test_bit_sliced_links_are_all_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 70, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (70, 4), dtype=np.uint64)
    x = np.concatenate([base, np.bitwise_xor.reduce(flips, axis=1) ^ base, base ^ flips[:, 0]])
    for n in (1, 63, 64, 65, len(x)):
        q, lane = simhash.links(x[:n], x, radius)
        want = {(i, j) for i in range(len(x)) for j in range(n) if (int(x[i]) ^ int(x[j])).bit_count() <= radius}
        assert set(zip(q.tolist(), lane.tolist(), strict=True)) == want


@pytest.mark.parametrize("rows", [4, simhash.ROWS])
def test_components(spark, rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "a", "A", "a b", "  a\tb "]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            copy[rng.randrange(150)] = rng.choice(words)
            texts += [" ".join(copy)] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    ids = [7 * i + 2**60 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, rows=rows).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[d].fp & (2**64 - 1) for d in ids] == fps
    assert [got[d].component_id for d in ids] == brute_components(ids, fps)


def test_a_chain_is_one_component(spark):
    n = 40
    fps = [(1 << min(i, 63)) - 1 for i in range(n)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    star = {r.node: r.root for r in simhash.components(simhash.link_forest(df, rows=5)).collect()}
    assert set(star) == set(fps[1:]) and set(star.values()) == {0}


def test_no_rows_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "x y z"), (5, "x y z"), (5, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 5), (5, 5), (5, 5)]
