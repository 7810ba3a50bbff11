import random

import regex

from veilgrove.llm import decontaminate as D

WORDS = "the river runs over cold stones while birds sing in tall trees near old town walls and people walk slowly home after long days at work".split()


def brute_tokens(text):
    """(canonical token, word) pairs, read word by word."""
    text = "".join(" " if c in D.NUMBER + D.NAME + D.UNIT else c for c in text or "")
    unit = r"(?:" + "|".join(D.UNITS) + r")(?![\p{L}\p{M}\p{N}])"
    out = []
    for m in regex.finditer(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[0-9]++(?:[.,:/][0-9]++)*+(?=(?i:{unit})|(?![\p{{L}}\p{{M}}\p{{N}}]))|[\p{{L}}\p{{M}}\p{{N}}]++", text):
        w = m[0]
        if regex.fullmatch(r"[0-9].*", w) and (regex.fullmatch(r"[0-9]+(?:[.,:/][0-9]+)*", w)):
            kind = D.NUMBER
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+", w) and regex.search(r"[\p{Ll},;:] $", text[max(0, m.start() - 2) : m.start()]):
            kind = D.NAME
        elif out and out[-1][0] == D.NUMBER and regex.fullmatch(rf"(?:{unit})", w.lower()) and not text[out[-1][2] : m.start()].strip():
            kind = D.UNIT
        else:
            kind = w.lower()
        out.append((kind, w.lower(), m.end()))
    return [(a, b) for a, b, _ in out]


def brute(docs, items):
    got = {}
    for i, item in items:
        it = brute_tokens(item)
        size = min(len(it), D.WINDOW)
        if not size:
            continue
        wins = [it[k : k + size] for k in range(len(it) - size + 1)]
        for d, text in docs:
            tok = brute_tokens(text)
            by = {}
            for p in range(len(tok) - size + 1):
                own = tok[p : p + size]
                for q, w in enumerate(wins):
                    if [x[0] for x in own] == [x[0] for x in w]:
                        pairs = {(x[0], x[1], y[1]) for x, y in zip(w, own, strict=True) if x[0] in (D.NUMBER, D.NAME, D.UNIT)}
                        places, slots = by.setdefault(p - q, (set(), set()))
                        places.add(q)
                        if pairs:
                            slots.add((tuple((x[0], x[1]) for x in w if x[0] in (D.NUMBER, D.NAME, D.UNIT)), tuple((y[0], y[1]) for x, y in zip(w, own, strict=True) if x[0] in (D.NUMBER, D.NAME, D.UNIT))))
            matched, same = set(), True
            for places, slots in by.values():
                flat = {pair for a, b in slots for pair in zip(a, b, strict=True)}
                if len({a for a, _ in flat}) == len(flat) and (size == D.WINDOW or all(a == b for a, b in flat)):
                    matched |= places
                    same &= all(a == b for a, b in flat)
            if len(matched) >= D.COVERAGE * len(wins) and matched:
                got[d, i] = (len(matched), len(wins), same)
    return got


def texts(seed):
    rng = random.Random(seed)
    fill = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    frames = ["If {n} has {a} apples and {n} buys {b} kg of pears then how many pieces does {n} hold in the end", "Nobody knew why {n} ran {a} miles before noon, yet {n} had run {a} miles again by dusk"]
    item = lambda f, n, a, b: frames[f].format(n=n, a=a, b=b)
    items = [(0, item(0, "Anna", 3, 4)), (1, item(1, "Bob", 5, 0)), (2, fill(12, 20)), (3, "six words are in this item"), (4, "too short"), (5, None), (6, "")]
    docs = [(None, f"so {item(0, 'Carl', 7, 9)} ok"), (1, None), (2, ""), (3, item(1, "Dora", 9, 1)), (4, f"{fill(3, 9)} {items[2][1]}. {fill(3, 9)}"), (5, "Hear: SIX words, are in -- this item!"), (6, item(1, "Eve", 2, 0).replace("run 2", "run 8"))]
    docs += [(7, fill(200, 300)), (8, item(0, "Fay", "1,200.5", "3").lower()), (9, items[2][1][: len(items[2][1]) // 3]), (10, "5kg 5 kg 12:30 a7 7a 3.x  the Cold River, Old"), (11, f"{item(0, 'Gus', 1, 2)}. {item(0, 'Hal', 8, 9)}")]
    for k in range(12, 40):
        parts = [rng.choice([fill(1, 12), item(rng.randint(0, 1), rng.choice(["Ann", "Ian", "Zoe"]), rng.randint(1, 30), rng.randint(1, 9)), items[2][1], str(rng.randint(1, 99)), "7 km"]) for _ in range(rng.randint(1, 5))]
        docs.append((k, rng.choice([" ", ". ", "\n"]).join(parts)))
    return docs, items


def test_tokens_and_values(spark):
    docs, items = texts(1)
    rows = [(k, t or "") for k, (_, t) in enumerate(docs + items)]
    got = {r.i: r for r in D.canonical(spark.createDataFrame(rows, "i int, text string"), "text").collect()}
    for k, t in rows:
        want = brute_tokens(t)
        assert got[k]["_tok"] == [a for a, _ in want], t
        if any(a in (D.NUMBER, D.NAME) for a, _ in want):
            assert [v.lower() for v in got[k]["_val"]] == [b for _, b in want], t


def test_contaminated_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = texts(seed)
        d = spark.createDataFrame(docs + docs[3:5], "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS hash")
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS size")
        got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.same_values) for r in D.contaminated(d, b).collect()}
        assert got == brute(docs, items)
        assert {(None, 0), (3, 1), (4, 2), (5, 3), (11, 0)} <= set(got) and (6, 1) not in got and (9, 2) not in got


def test_empty_tables_and_long_texts(spark):
    docs, items = texts(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(WORDS) * 3000 + " " + items[2][1]), (2, "x" * 200_000), (3, "7 " * 20_000)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()] == [(1, 2)]
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b.limit(0)).count() == 0


def test_both_ways_of_joining_agree(spark, monkeypatch):
    docs, items = texts(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, D.contaminated(d, b).collect())) == one


def test_short_items_count_with_their_own_values(spark):
    bench = spark.createDataFrame([(1, "What is 42?"), (2, "Zanzibar"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so WHAT is 42, then"), (2, "what is 43?"), (3, "they went to zanzibar by boat"), (4, ""), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (3, 2)}
