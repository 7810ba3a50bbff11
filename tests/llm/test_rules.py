import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from veilgrove.llm import rules

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    places = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), len(w) < 50 or 100 * len(places) > 50 * len(w)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS _w")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLUMNS) == brute(t), t
        assert not (got[i].base_failed and got[i].kept)
    return got


PROSE = "the work of the day is done and it was good for all that came with us to see new things on a long road from here to there by night or by day as they said in old songs about rivers trees stones birds fish wind rain snow sun moon stars"


def test_measures_and_verdicts(spark):
    junk = " ".join(f"w{i}###" for i in range(60))
    shout = " ".join(f"W{chr(65 + i % 26)}X!!" for i in range(60))
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "x\nx\n\nx \n x", "a a a a a", PROSE, junk, shout, "the same line\n" * 60, PROSE + " é", "the cat " * 20000]
    got = check(spark, texts)
    assert got[8].kept and not got[9].kept and not got[10].kept and not got[11].kept


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\t\x0b é", max_size=80), min_size=1, max_size=40))
def test_any_text(spark, texts):
    check(spark, texts)


def test_no_rows(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
