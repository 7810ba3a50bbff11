import random
import re

import corpus_pipeline
from veilgrove.llm import simhash


def brute_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return {d: low[root(i)] for i, (d, _) in enumerate(rows)}


def texts(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(500)]
    out = [None, "", " \n", "a", "A", "a b", "  a\tb ", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.randint(20, 400))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(base))] = rng.choice(words)
            copy = copy[: len(copy) - rng.choice([0, 0, 3])]
            out += [" ".join(copy), "\n".join(copy).lower()][: rng.choice([1, 1, 2])]
    rng.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n").repartition(3)
        assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == brute(rows)


def test_the_stage_takes_edited_copies_out(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    edited = list(base)
    for k in (40, 110, 170, 220, 260):
        edited[k] = "new"
    other = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (3, " ".join(other), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_no_rows_and_null_ids(spark):
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "x y z"), (5, "x y z"), (5, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_copies(df).collect()) == [(0, 5), (5, 5), (5, 5)]


def test_a_group_about_the_threshold(spark, monkeypatch):
    """Texts whose pairs lie on either side of 0.8, in small blocks; and the pairs that are verified stay few."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(120), 2):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    seen = []
    real = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, *a, **kw: (seen.append(pairs.count()), real(pairs, *a, **kw))[1])
    monkeypatch.setattr(simhash, "COPY_ROWS", 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == brute(rows)
    assert sum(seen) <= 6 * len(rows)


def test_keep_one_of_equal_rows_and_null_ids(spark):
    rows = [(None, "x y z"), (5, "x y z"), (5, "x y z"), (5, "other words"), (None, "third text here"), (None, None), (9, " ")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "third text here"), (5, "other words"), (5, "x y z"), (9, " ")]
