import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilgrove.llm import bpe


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    letters = "abcdeétheingß 1.,'s\nńİΣAB\t\x1c 한"
    out = [None, "", " ", "a", "\n\n", "<|endoftext|>", "x<|endoftext|>y", "é" * 50, "don't they've 12345"]
    for k in range(40):
        n = rng.choice([3, 40, 400])
        out.append("".join(rng.choice(letters if k % 2 else "theingouab") for _ in range(n)))
    mixed = "".join(rng.choice(["theing", "x", "1", "'s", "é", "!!", "<|endoftext|>", "ß"]) for _ in range(900))
    return [*out, out[-1], "ab" * 3000 + "'s" + "0" * 50, "word " * 2000, "some words " + mixed + " and\nmore " + "zq" * 700 + " end"]


@pytest.mark.parametrize(("leaf", "window", "block"), [(8, 1, 50), (16, 2, 1 << 20), (bpe.LEAF, bpe.WINDOW, 500)])
def test_digests_are_those_of_the_library(spark, lib, leaf, window, block):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, block string")
    got = {r.doc_id: r for r in bpe.digests(df, leaf=leaf, window=window, block=block).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_real_documents_go_through_the_tree(lib, monkeypatch):
    """At default sizes a text of three thousand characters is cut in half, anywhere, and its halves are joined."""
    codec = bpe._Codec(bpe.default_tokenizer(), bpe.LEAF, bpe.WINDOW)
    seams = []
    real = codec.seam
    monkeypatch.setattr(codec, "seam", lambda left, before, after, right: (seams.append(before + "|" + after), real(left, before, after, right))[1])
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 14))) for _ in range(800))
    assert codec.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(seams) == 7 and any(len(x) > 3 and x[0] != "|" and x[-1] != "|" for x in seams)


def test_a_long_run_is_many_blocks_on_many_tasks(spark, lib):
    """Megabytes without a blank, at default sizes: pieces of one pre-token, and pre-tokens, as rows."""
    rng = random.Random(5)
    letters = "".join(rng.choice("theingoraus") for _ in range(2_200_000))
    mixed = "".join(rng.choice(["theing", "1", "'s", "!!"]) for _ in range(30_000))
    codec = bpe._Codec.of(bpe.default_tokenizer())
    kinds = [k for k, _ in bpe.blocks_of("a b " + letters + " c", bpe.BLOCK, codec)]
    assert kinds.count(bpe.PIECE) > 60 and kinds.count(bpe.LAST) == 1
    rows = [(1, "a b " + letters + " c"), (2, mixed)]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[1:]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    # The library is quadratic in so long a pre-token; a tree with other leaves must agree, and so must the text.
    other = bpe._Codec(bpe.default_tokenizer(), 500, 3).encode(rows[0][1])
    assert got[1].ids_sha256 == hashlib.sha256(other.tobytes()).hexdigest()
    assert "".join(codec.names[i].removesuffix("</w>") for i in other[2:-1]) == letters


def test_frames_round_trip(spark, lib):
    df = spark.createDataFrame([(1, "the the"), (1, "the the"), (2, None)], "doc_id long, text string")
    enc = bpe.encode_frame(df)
    assert enc.count() == 3
    back = sorted((r.doc_id, r.text) for r in bpe.decode_frame(enc).collect())
    want = lib.decode(lib.encode("the the", add_special_tokens=False).ids, skip_special_tokens=False)
    assert back == [(1, want), (1, want), (2, "")]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.digests(df).count() == 0
