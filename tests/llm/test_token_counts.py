import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from veilgrove.llm import token_counts as T


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(4)
    out = [None, "", "\n", "\n\n\n", "a", "Title\n\nBody here.\n\n\n  \nmore", " \n x", "é\n한글\n🙂🙂\n", "<|endoftext|>"]
    for _ in range(60):
        out.append("".join(rng.choice(["the ", "ing", "\n", "\n\n", " ", "é", "🙂", "12", "?!", "\t", "Word"]) for _ in range(rng.randint(1, 80))))
    return out


def brute(lib, text, rule):
    """Every token against every line, by characters."""
    spans = lib.encode(text, add_special_tokens=False).offsets
    sections, at = [], 0
    for part in text.split("\n"):
        sections.append((at, at + len(part) + 1))
        at += len(part) + 1
    per, crossing = [0.0] * len(sections), 0
    for a, b in spans:
        over = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        crossing += sum(x > 0 for x in over) > 1
        if rule == "start":
            per[next(i for i, (s, e) in enumerate(sections) if s <= a < e)] += 1
        elif rule == "majority":
            per[over.index(max(over))] += 1
        else:
            for i, x in enumerate(over):
                per[i] += x / sum(over)
    return len(spans), crossing, per


@pytest.mark.parametrize("rule", T.RULES)
def test_counts_against_brute_force(spark, lib, rule):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = {r.doc_id: r for r in T.count(df, rule=rule).collect()}
    for i, t in enumerate(rows):
        n, crossing, per = brute(lib, t or "", rule)
        assert (got[i].n_tokens, got[i].n_crossing) == (n, crossing), t
        assert np.allclose(got[i].section_tokens, per), t
        assert np.isclose(got[i].title_tokens + got[i].body_tokens + got[i].blank_tokens, n)


def test_spans_are_those_of_the_library(lib):
    for t in filter(None, texts()):
        e = lib.encode(t, add_special_tokens=False)
        assert T.token_spans(t) == [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)], t


def test_very_long_texts():
    for t in (" " * 100_000, "a" + " " * 100_000 + "b", "\n" * 60_000 + "x", "a" * 100_000):
        ids, edges = T.encode(t)
        assert edges[-1] == len(t) and len(ids)
    short, _ = T.encode("x" + " " * 300 + "y")
    T_wide, T._WIDE = T._WIDE, T.re.compile(r"\s{100,}")
    try:
        assert T.encode("x" + " " * 300 + "y")[0].tolist() == short.tolist()
    finally:
        T._WIDE = T_wide


def test_bad_rule_and_no_rows(spark):
    with pytest.raises(ValueError):
        T.attribute(np.array([0, 1]), np.array([0]), b"a", "most")
    assert T.count(spark.createDataFrame([], "doc_id long, text string")).count() == 0
