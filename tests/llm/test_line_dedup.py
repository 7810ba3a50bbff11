import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from veilgrove.llm import line_dedup as L


def brute(rows):
    """Every line against every earlier one."""
    docs = {}
    for i, t in rows:
        docs.setdefault(i, t or "")
    order = sorted(docs, key=lambda i: -(2**63) if i is None else i)
    seen, gone = [], set()
    for i in order:
        for k, text in enumerate(docs[i].split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", text))
            if not w:
                continue
            if any((u == w and j == i) if len(w) < L.MIN_WORDS else len(u) >= L.MIN_WORDS and 5 * len(u & w) >= 4 * len(u | w) for j, u in seen):
                gone.add((i, k))
            seen.append((i, w))
    return gone


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 30
    bases = [[rng.choice(words) for _ in range(rng.randint(4, 40))] for _ in range(25)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            b = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                b[rng.randrange(len(b))] = rng.choice(words)
            if rng.random() < 0.2:
                rng.shuffle(b)
            lines.append(rng.choice([" ", "  ", "\t"]).join(b))
        lines += rng.choices(["", " ", "a", "a b", "b a", "of the and", "é ñ"], k=rng.randint(0, 3))
        rng.shuffle(lines)
        out.append((i * 3, "\n".join(lines)))
    return [*out, (None, "w1 w2 w3 w4 w5 w6"), (7, None), (8, ""), (10, "\n\n"), (11, "x y z p q r s t u v " * 3000), (13, "x y z p q r s t u v\nw1 w2 w3 w4 w5 w6"), out[3], out[3]]


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, line int").selectExpr("*", "'z' AS doc", "2 AS key").repartition(3)
    got = {r.line: r for r in L.dedup(df, **kw).collect()}
    gone = brute(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        want = "\n".join(x for m, x in enumerate((t or "").split("\n")) if (i, m) not in gone)
        assert got[k].text == want, (i, t)
        assert got[k].doc == "z" and got[k].n_removed == sum(d == i for d, _ in gone)


@pytest.mark.parametrize(("seed", "cold"), [(1, L.COLD), (3, 2)])
def test_against_brute_force(spark, seed, cold):
    check(spark, texts(seed), cold=cold)


def test_the_ways_beyond_the_broadcast_bounds(spark, monkeypatch):
    for name in ("BROADCAST_KEYS", "BROADCAST_ROWS", "BROADCAST_LINES", "BROADCAST_SETS"):
        monkeypatch.setattr(L, name, 0)
    check(spark, texts(4, 30), cold=2)


def test_word_hashes():
    rng = random.Random(8)
    for _ in range(50):
        t = "".join(rng.choice("ab \n\té\x0bc") for _ in range(rng.randint(0, 60)))
        raw = np.frombuffer(t.encode(), np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
        h, line = L.word_hashes(raw, starts)
        want = [(w, k) for k, x in enumerate(t.split("\n")) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
        assert line.tolist() == [k for _, k in want]
        assert len({*zip(h.tolist(), (w for w, _ in want), strict=True)}) == len(set(h.tolist())) == len({w for w, _ in want})


def sets_of(a, b, words):
    out = {"doc": np.array([1, 2]), "line": np.array([0, 0]), "later": np.array([True, True])}
    out["n"] = np.array([len(a), len(b)])
    out["place"] = np.array([sorted(t).index(min(a & b)) for t in (a, b)])
    out["sig"] = np.concatenate([L.signature(np.array(sorted(t), np.uint64), np.zeros(len(t), int), 1, words) for t in (a, b)])
    return out


@pytest.mark.parametrize("words", [L.SIGNATURE, L.WIDE])
def test_filters_keep_every_similar_pair(words):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.choice(10_000, rng.integers(1, 300), replace=False)
        b = a.copy()
        k = rng.integers(0, max(1, len(a) // 8) + 1)
        b[:k] = 20_000 + np.arange(k)
        x, y = set(a.tolist()), set(b[: max(1, len(b) - int(rng.integers(0, 2)))].tolist())
        if x == y or 5 * len(x & y) < 4 * len(x | y):
            continue
        c = sets_of(x, y, words)
        assert (c["place"] < L.prefix_length(c["n"])).all()
        assert [v.tolist() for v in L.compare_groups(np.array([0, 0]), c)] == [[1], [0]]


def test_no_key_where_only_equal_sets_are_similar():
    assert L.prefix_length(np.array([1, 2, 3, 4, 5, 10])).tolist() == [0, 0, 0, 1, 2, 3]


def test_differing():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (200, 64)), rng.integers(0, 4, (200, 64))
    pack = lambda v: (v.reshape(200, 2, 32).astype(np.uint64) << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)
    d = (a - b) % 4
    assert L.differing(pack(a), pack(b)).tolist() == np.minimum(d, 4 - d).sum(1).tolist()


def near_group(n, words=80, seed=5):
    """Lines of a group whose pairs are on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"g{k}" for k in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), words // 9):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("cold", "tries"), [(40, 1)])
def test_a_group_of_near_copies(spark, cold, tries):
    rows = near_group(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute(rows)
    assert {r.doc_id for r in L.dedup(df, cold=cold, tries=tries).where("n_removed > 0").collect()} == {i for i, _ in gone}


def test_pairs_of_a_group_are_not_listed(spark, monkeypatch):
    """Verified pairs stay in proportion to a group of near copies."""
    seen = []
    real = L.verified
    monkeypatch.setattr(L, "verified", lambda pairs, sets: (seen.append(pairs.count()), real(pairs, sets))[1])
    n = 400
    L.removed_lines(spark.createDataFrame(near_group(n), "doc_id long, text string")).count()
    assert sum(seen) <= n * (1 + L.TRIES)


def test_null_and_repeated_ids_with_different_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, a + "\nkeep me here now"), (None, b), (None, "x\n" + b), (5, a), (5, "other words in this line here\nlast"), (5, "other words in this line here\nlast")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.dedup(df).collect()
    assert len(got) == len(rows)
    lines = [x for r in got for x in r.text.split("\n") if x]
    assert sorted(lines) == sorted([a, "keep me here now", b, "x", *["other words in this line here", "last"] * 2])


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", 7, 8, 9, "d")], "doc_id long, text string, n_lines int, N_REMOVED int, _doc int, _gone string")
    for bound in (L.BROADCAST_LINES, 0):
        L.BROADCAST_LINES, old = bound, L.BROADCAST_LINES
        r = L.dedup(df).first().asDict()
        L.BROADCAST_LINES = old
        assert r == {"doc_id": 1, "text": "a b c", "n_lines": 7, "N_REMOVED": 8, "_doc": 9, "_gone": "d", "n_lines_": 2, "n_removed_": 1}


def test_no_rows(spark):
    assert L.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_are_sorted_by_one_number(spark):
    rows = spark.createDataFrame([(-5, 1, 0, 3, 0, 0, 0)], "key int, doc bigint, line int, n int, place int, b1 bigint, b2 bigint")
    for df in (rows, rows.withColumn("block", F.lit(1)).withColumn("later", F.lit(True))):
        plan = L.candidates(df)._jdf.queryExecution().executedPlan().toString()
        (sort,) = re.findall(r"Sort \[([^\n]*)\], false", plan)
        assert sort.count("ASC") == 1 and "doc" not in sort, sort


def test_candidates_come_in_the_order_of_lines(spark):
    # One group under a negative key, its rows shuffled: the first two of all that are equal but for their lines.
    at = [(d, k) for d in (-3, 0, 2**40) for k in (0, 7)]
    rows = [(key, d, k, 9, 0, 5, 6) for d, k in random.Random(3).sample(at, len(at)) for key in (-9, 4)]
    df = spark.createDataFrame(rows, "key int, doc bigint, line int, n int, place int, b1 bigint, b2 bigint")
    got = {((r.doc, r.line), (r.doc2, r.line2), r.more) for r in L.candidates(df, 2).collect()}
    assert got == {(x, y, key if i > 1 else None) for i, x in enumerate(at) for y in at[: min(i, 2)] for key in (-9, 4)}


@pytest.mark.parametrize("doc", [[1, 1, 0], [2**62, 1, -(2**62)]])
def test_order_of_rows(doc):
    group, doc, line = np.array([0, 0, 0]), np.array(doc), np.array([7, 2, 9], np.int32)
    assert L.in_order(group, doc, line).tolist() == [2, 1, 0]


def test_hashes_of_long_words():
    # Words that differ in their last byte only, and each twice: behind different bytes, and with a byte of zero more.
    words = [b"x" * n + last for n in (0, 6, 7, 8, 15, 16, 62, 63, 64, 65, 200) for last in (b"a", b"b", b"a\0")]
    raw = np.frombuffer(b" ".join(words) + b"\n\n  " + b"\t".join(words), np.uint8)
    h, line = L.word_hashes(raw, np.concatenate([[0], np.flatnonzero(raw == 10) + 1]))
    assert h[: len(words)].tolist() == h[len(words) :].tolist() and len(set(h.tolist())) == len(words)
    assert line.tolist() == [0] * len(words) + [2] * len(words)


def test_wanted_lines():
    known, wanted = np.array([-4, 9]), np.array([0 << 32 | 2, 1 << 32 | 0, 1 << 32 | 5])
    doc, number = np.array([-9, -4, -4, 3, 9, 9, 9, 11]), np.array([2, 2, 0, 2, 0, 5, 2, 5])
    assert L._among(doc, number, known, wanted).tolist() == [False, True, False, False, True, True, False, False]
    assert not L._among(doc, number, known[:0], wanted[:0]).any()


def near_the_threshold():
    # One word in all lines, then many dissimilar ones with equal sizes before a line that is similar to the last of them only.
    rng = random.Random(12)
    lines = [["rare", *rng.sample([f"w{k}" for k in range(30)], 24)] for _ in range(40)]
    return [(i, " ".join(x)) for i, x in enumerate([*lines, [*lines[-1][:-1], "other"]])] + [(100 + i, f"alone{i}") for i in range(2000)]


@pytest.mark.parametrize("few, cold", [(2, L.COLD), (5, L.COLD), (2, 20)])
def test_a_second_look_with_more_tries(spark, monkeypatch, few, cold):
    monkeypatch.setattr(L, "MORE_TRIES", few)
    seen, original = [], L.candidates
    monkeypatch.setattr(L, "candidates", lambda rows, most=1: seen.append(most) or original(rows, most))
    check(spark, near_the_threshold(), cold=cold, tries=1)
    check(spark, texts(6), cold=cold, tries=1)
    assert few in seen


def test_few_open_lines_need_no_wide_signatures(spark, monkeypatch):
    monkeypatch.setattr(L, "wide_signatures", None)
    plenty = [(5000 + i, f"more{i}") for i in range(20_000)]
    got = {tuple(r) for r in L.removed_lines(spark.createDataFrame(near_the_threshold() + plenty, "doc_id long, text string"), tries=1).collect()}
    assert got == brute(near_the_threshold())
