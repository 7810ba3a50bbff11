import random
import re

import regex

from tests.llm import heldout
from veilgrove.llm import pii


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


TEXTS = [
    None, "", "nobody", "a.b@c.d", "a@b.c_d@e.f", "x" * 3000 + "@", "é🙂 me@mail.example.com, 10.0.0.1", "256.1.1.1 1.2.3.4.5.6.7.8 0001.002.03.4 99999999999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "card 4012-8888-8888-1881x",
    "+1 (386) 555-3733 ou", "+1 234 567 8901 2345 6789", "++1 2345678901", "1-" * 30_000 + "1", "a" * 100_000, "me@x.y " * 400, "5" * 50_000, "tel. (386) 555-3733, SSN 123-45-6789", "+49 30 901820.",
]


def test_base_spans(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", "_", "+", " ", "(", ")", "12", "7", "255", "256", "0", "4111111111111111", "é", "\n", "x@y.z"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS d", "3 AS id")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[i].base == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want), t[:200]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if s.split(":")[0] in pii.KINDS[:4]] == [s for s in got[i].base.split(",") if s]
        assert len(spans) - len(want) == got[i].n_more


def test_trees_find_more_and_leave_numbers_alone(spark):
    texts = ["tel. (386) 555-3733 then", "the SSN 123-45-6789 of", "order 386 555 3733 was", "invoice 20240117 paid", "write to a.b [at] c.example (dot) com now", "total 123456789 rows"]
    got = [r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert "phone_local:5:19" in got[0] and "social:8:19" in got[1] and "email_hidden" in got[4]
    assert got[2] == got[3] == got[5] == ""


def test_compiled_trees_are_the_fitted_trees(spark):
    model = pii.fit(spark)
    rows = [{n: float(random.Random(i * 31 + k).randint(0, 12)) for k, n in enumerate(pii.FEATURES)} for i in range(50)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f map<string,double>")
    sql = " + ".join([f"{model.bias!r}D", *(pii.tree_sql(t) for t in model.trees)])
    got = [r[0] for r in df.orderBy("i").selectExpr(sql).collect()]
    assert all(abs(g - model.score(r)) < 1e-9 for g, r in zip(got, rows, strict=True))


def test_no_user_functions_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_recall_and_precision_on_texts_of_another_maker(spark):
    data = heldout.texts(heldout.personal, heldout.harmless, 400, 92)
    got = pii.personal_data(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")).orderBy("doc_id").collect()
    there = caught = found = wrong = 0
    for (_, spans), r in zip(data, got, strict=True):
        own = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        for a, b in spans:
            there += 1
            caught += len({k for x, y in own for k in range(max(a, x), min(b, y))}) >= 0.8 * (b - a)
        found += len(own)
        wrong += sum(not any(a < y and x < b for a, b in spans) for x, y in own)
    assert caught / there >= 0.9 and wrong / found <= 0.1


def brute_added(model, text):
    """Added candidates one by one, with features by SQL's definitions read anew in Python, and the merge of spans by hand."""
    base = brute_base(text)
    luck = []
    for k, g in enumerate(pii.MORE, len(pii.BASE)):
        pattern = regex.compile(g.pattern)
        ends = 0
        ms = list(pattern.finditer(text))
        for i, m in enumerate(ms):
            pre, post = text[ends : m.start()][-40:], text[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(text)][:12]
            ends = m.end()
            x, low = m[0], pre.lower()
            digits = regex.sub("[^0-9]", "", x)
            hit = lambda p, t: float(bool(regex.search(p, t)))
            sql = lambda name: pii.FEATURES[name].split("RLIKE '")[1].rsplit("')", 1)[0].replace("\\\\", "\\")
            row = {
                "digits": len(digits), "length": len(x), "blanks": x.count(" "), "hyphens": x.count("-"), "points": x.count(".") + x.count("/"), "upper": len(regex.findall("[A-Z]", x)), "distinct_digits": len(set(digits)) or 1,
                "joined_before": hit(sql("joined_before"), pre), "joined_after": hit(sql("joined_after"), post), "money_before": hit(sql("money_before"), pre), "unit_after": hit(sql("unit_after"), post),
                **{n: hit(sql(n), low) for n in ("call", "identity", "bank", "contact", "machine", "counted", "counted_near")}, **{f"is_{h.kind}": float(h is g) for h in pii.MORE},
            }
            if model.score({n: float(v) for n, v in row.items()}) >= model.thresholds[g.kind]:
                luck.append((m.start(), k, m.end()))
    out, to = [], -1
    for s, k, e in sorted(base + luck):
        if k < len(pii.BASE) or e > to:
            out.append((s, k, e))
            to = max(to, e)
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in out)


def test_added_spans_and_merge_against_brute_force(spark):
    model = pii.fit(spark)
    data = [t for t, _ in heldout.texts(heldout.personal, heldout.harmless, 120, 93)] + [t for t, _ in pii.training_texts(120, 5)]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(data, got, strict=True):
        assert r.spans == brute_added(model, t), t


def test_many_matches_and_repeated_rows(spark):
    text = "me@x.yz, call (386) 555-3733; " * 3000
    got = pii.personal_data(spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")).collect()
    assert sorted(r.n_email for r in got) == [0, 3000, 3000]
    one, two = (r.spans for r in got if r.doc_id == 1)
    assert one == two and one.count("phone_local") == 3000
