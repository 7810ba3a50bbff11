"""BPE encoding and decoding by tree concatenation.

Texts of more than ``LEAF`` characters are cut in half wherever the half falls;
the halves are encoded apart, recursively, and a window around each join is
encoded again and grown until it ends on both sides where the halves' encodings
must agree with the whole's: at blanks, which the tokenizer's pre-tokenizer never
joins anything over (``_Codec.seam``).  A pre-token that stays long, such as a
megabyte of letters without a blank, has no such place; there the window is one
of tokens, grown until its outermost tokens are those that both sides already
have (``_Codec.join``).  Then every neighbouring pair of tokens in the joined list
is one that the merge rules leave alone, which makes the list the encoding of the
whole.  Runs between blanks are encoded once a worker.

The tree's upper levels are rows: texts of more than ``BLOCK`` characters are cut
into blocks, which are dealt over all tasks, encoded there, and joined where they
meet.  A long stretch without blanks is cut between pre-tokens, and a long
pre-token anywhere.

Defined cases: a null text is the empty text and has no tokens; empty text has
zero tokens and decodes to the empty string; repeated rows give repeated rows;
an empty table gives an empty result with the same columns; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import ddl, map_texts, text_or_empty

#: Characters of a text or of a pre-token above which it is encoded as a tree of halves.
LEAF = 2048
#: Tokens, or characters, on either side of a join in the first window.
WINDOW = 8
#: Characters above which a text is dealt out in blocks.
BLOCK = 1 << 15
#: Entries of the per-worker cache of encoded runs, and the longest run in it.
CACHE, CACHED = 200_000, 48

_BLANK = re.compile(r"[ \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Runs(dict):
    """Runs to the bytes of their ids; bounded, and filled on the way."""

    def __init__(self, codec: _Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, run: str) -> bytes:
        got = np.array(self.codec.run(run), dtype="<u4").tobytes()
        if len(run) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[run] = got
        return got


class _Codec:
    """One tokenizer in one worker: encodes runs and pre-tokens, decodes ids."""

    _own: dict[tuple, _Codec] = {}

    @classmethod
    def of(cls, path: str, leaf: int = LEAF, window: int = WINDOW) -> _Codec:
        if (path, leaf, window) not in cls._own:
            cls._own[path, leaf, window] = cls(path, leaf, window)
        return cls._own[path, leaf, window]

    def __init__(self, path: str, leaf: int, window: int) -> None:
        from tokenizers import Tokenizer

        self.path, self.leaf, self.window = path, leaf, window
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.suffix = getattr(self.tok.model, "end_of_word_suffix", None) or ""
        self.names = [self.tok.id_to_token(i) or "" for i in range(max(self.tok.get_vocab(True).values()) + 1)]
        self.cache = _Runs(self)

    @functools.cached_property
    def pieces(self) -> tuple:
        """Models of a piece that another piece of the same pre-token follows, and of a pre-token's last piece; made where there is such a one."""
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        common = {"vocab": model["vocab"], "merges": merges, "fuse_unk": model.get("fuse_unk", False)}
        inner = BPE(**common)
        return inner, BPE(**common, end_of_word_suffix=self.suffix) if self.suffix else inner

    # -- the tree -----------------------------------------------------------
    def _text(self, ids: list[int]) -> str:
        out = "".join(self.names[i] for i in ids[:-1])
        return out + self.names[ids[-1]].removesuffix(self.suffix) if ids and self.suffix else out + "".join(self.names[i] for i in ids[-1:])

    def _piece(self, text: str, last: bool) -> list[int]:
        return [t.id for t in self.pieces[last].tokenize(text)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of two neighbouring pieces from the encodings of each."""
        if not left or not right:
            return left + right
        k = self.window
        while True:
            a, b = left[-k:], right[:k]
            ends = k >= len(right)
            again = self._piece(self._text(a) + (self._text(b) if ends and last else "".join(self.names[i] for i in b)), ends and last)
            if (k >= len(left) or again[0] == a[0]) and (ends or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            k *= 2

    def tree(self, text: str, last: bool = True) -> list[int]:
        """Encoding of one pre-token, in the tokenizer's byte alphabet."""
        if len(text) <= self.leaf:
            return self._piece(text, last)
        half = len(text) // 2
        return self.join(self.tree(text[:half], False), self.tree(text[half:], last), last)

    # -- runs and texts -------------------------------------------------------
    def words(self, run: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens of a text in the tokenizer's byte alphabet, and special tokens as they are."""
        at = 0
        marks = re.finditer("|".join(map(re.escape, self.special)), run) if self.special else ()
        for m in [*marks, None]:
            part = run[at : m.start() if m else len(run)]
            if part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    yield word, False
            if m:
                yield m[0], True
                at = m.end()

    def run(self, run: str) -> list[int]:
        """Ids of a text without a blank inside, or of any text at all."""
        if len(run) <= self.leaf:
            return self.tok.encode(run, add_special_tokens=False).ids
        out: list[int] = []
        for word, special in self.words(run):
            out += [self.tok.token_to_id(word)] if special else self.tree(word)
        return out

    def edges(self, text: str, lo: int, at: int, hi: int) -> tuple[int, int]:
        """The window about ``at``, grown to the blanks on either side, or to ``lo`` and ``hi``."""
        k = self.window
        while (a := max(text.rfind(" ", max(lo, at - k), at), text.rfind("\n", max(lo, at - k), at))) < 0 and at - k > lo:
            k *= 2
        m = _BLANK.search(text, at, hi)
        return (a + 1 if a >= 0 else lo), (m.start() if m else hi)

    def seam(self, left: bytes, before: str, after: str, right: bytes) -> bytes:
        """Ids of two neighbouring stretches from those of each; ``before`` and ``after`` are the halves of the run that the cut went through."""
        if not before or not after:
            return left + right
        return left[: len(left) - len(self.cache[before])] + self.cache[before + after] + right[len(self.cache[after]) :]

    def halves(self, text: str, lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return b"".join(map(self.cache.__getitem__, text[lo:hi].replace("\n", " ").split(" ")))
        at = (lo + hi) // 2
        a, b = self.edges(text, lo, at, hi)
        if b - a > self.leaf:  # the run is long itself: a tree of its own
            return (self.halves(text, lo, a) if lo < a else b"") + np.array(self.run(text[a:b]), "<u4").tobytes() + (self.halves(text, b, hi) if b < hi else b"")
        return self.seam(self.halves(text, lo, at), text[a:at], text[at:b], self.halves(text, at, hi))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.halves(text, 0, len(text)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(); without a decoder that is a join of token strings, in slices."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, ids.tolist()))


#: Kinds of block: a stretch of text, whole pre-tokens, a piece of a pre-token, its last piece, a special token.
TEXT, WORDS, PIECE, LAST, SPECIAL = range(5)


def blocks_of(text: str, size: int, codec: _Codec) -> Iterator[tuple[int, str]]:
    """(kind, string) of the blocks of a text, of ``size`` characters where they are text.

    Cuts fall anywhere, but not in a run of more than ``codec.leaf`` characters:
    such a one goes as pre-tokens, joined by blanks, which their alphabet lacks.
    """
    at = 0
    while len(text) - at > size:
        a, b = codec.edges(text, at, at + size, len(text))
        if b - a <= codec.leaf:
            yield TEXT, text[at : at + size]
            at += size
            continue
        if a > at:
            yield TEXT, text[at:a]
        held: list[str] = []
        length = 0
        for word, special in codec.words(text[a:b]):
            if held and (special or length + len(word) > size):
                yield WORDS, " ".join(held)
                held, length = [], 0
            if special:
                yield SPECIAL, word
            elif len(word) > size:
                for k in range(0, len(word), size):
                    yield (PIECE if k + size < len(word) else LAST), word[k : k + size]
            else:
                held.append(word)
                length += len(word) + 1
        if held:
            yield WORDS, " ".join(held)
        at = b
    if at < len(text) or not text:
        yield TEXT, text[at:]


def encode_block(codec: _Codec, kind: int, text: str) -> bytes:
    if kind == TEXT:
        return codec.encode(text).tobytes()
    if kind == SPECIAL:
        return np.array([codec.tok.token_to_id(text)], "<u4").tobytes()
    words = text.split(" ") if kind == WORDS else [text]
    return b"".join(np.array(codec.tree(w, kind != PIECE), "<u4").tobytes() for w in words)


def joined(codec: _Codec, blocks: list[tuple[int, bytes, str, str, bool]]) -> bytes:
    """Ids of a text from its blocks in order: kind, ids, the text before its first and after its last blank, and whether it has none."""
    out: list[bytes] = []
    tail = ""  # the text of the run that the last block ends in, whose ids are out[-1]
    open_: list[int] | None = None  # ids of a pre-token whose last piece is still to come
    for kind, ids, head, end, whole in blocks:
        if kind in (PIECE, LAST):
            own = np.frombuffer(ids, "<u4").tolist()
            open_ = own if open_ is None else codec.join(open_, own, kind == LAST)
            if kind == LAST:
                out.append(np.array(open_, "<u4").tobytes())
                open_ = None
            tail = ""
        elif kind != TEXT:
            out.append(ids)
            tail = ""
        elif whole:
            if tail and head:
                out[-1] = codec.seam(out[-1], tail, head, ids)
                tail += head
            else:
                out.append(ids)
                tail = head or tail
        else:
            n, m = len(codec.cache[head]), len(codec.cache[end])
            if tail and head:
                out[-1] = codec.seam(out[-1], tail, head, ids[:n])
                ids = ids[n:]
            out += [ids[: len(ids) - m], ids[len(ids) - m :]]
            tail = end
    return b"".join(out)


def _encoded(src: DataFrame, id_col: str, text_col: str, path: str, block: int, leaf: int, window: int, fields: str, finish: Callable[[_Codec, list[bytes]], list[pa.Array]]) -> DataFrame:
    """id and what ``finish`` makes of each text's ids.

    Texts up to ``block`` characters are not moved.  Blocks of longer ones are
    dealt over all tasks to be encoded, and meet again by row, only as ids and
    the runs that the cuts went through.
    """

    def whole() -> Callable[[list[str]], list[pa.Array]]:
        codec = _Codec.of(path, leaf, window)
        return lambda texts: finish(codec, [codec.encode(t).tobytes() for t in texts])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec.of(path, leaf, window)
        for b in batches:
            for k, text in enumerate(b.column(text_col).to_pylist()):
                for n, (kind, part) in enumerate(blocks_of(text, block, codec)):  # one block at a time: bounded memory
                    yield pa.RecordBatch.from_arrays([b.column(id_col).slice(k, 1), b.column("row").slice(k, 1), pa.array([n], pa.int32()), pa.array([kind], pa.int32()), pa.array([part])], names=[id_col, "row", "block", "kind", text_col])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec.of(path, leaf, window)
        for b in batches:
            kinds, texts = b.column("kind").to_pylist(), b.column(text_col).to_pylist()
            split = [(_BLANK.search(t), max(t.rfind(" "), t.rfind("\n"))) if k == TEXT else (None, -1) for k, t in zip(kinds, texts, strict=True)]
            heads = [(t[: m.start()] if m else t) if k == TEXT else "" for k, t, (m, _) in zip(kinds, texts, split, strict=True)]
            ends = [t[r + 1 :] if k == TEXT else "" for k, t, (_, r) in zip(kinds, texts, split, strict=True)]
            ids = [encode_block(codec, k, t) for k, t in zip(kinds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("row"), b.column("block"), b.column("kind"), pa.array(ids, pa.binary()), pa.array(heads, pa.string()), pa.array(ends, pa.string()), pa.array([m is None for m, _ in split])], names=[id_col, "row", "block", "kind", "ids", "head", "tail", "whole"])

    def met(t: pa.Table) -> pa.Table:
        codec = _Codec.of(path, leaf, window)
        t = t.sort_by("block")
        blocks = list(zip(*[t.column(c).to_pylist() for c in ("kind", "ids", "head", "tail", "whole")], strict=True))
        return pa.Table.from_arrays([t.column(id_col).slice(0, 1), *finish(codec, [joined(codec, blocks)])], names=[id_col, *names])

    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    short = map_texts(src.where(F.length(text_col) <= block), [id_col], text_col, fields, whole)
    kept = f"{ddl(src, id_col)}, row bigint, block int, kind int"
    long = src.where(F.length(text_col) > block).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut_up, f"{kept}, {text_col} string")
    done = long.repartition("row", "block").mapInArrow(encode, f"{kept}, ids binary, head string, tail string, whole boolean")
    return short.unionByName(done.groupBy("row").applyInArrow(met, f"{ddl(src, id_col)}, {fields}"))


def _renamed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text alone, under names that none of the columns made here has."""
    return text_or_empty(docs, id_col, text_col).select(F.col(id_col).alias("_own_id"), F.col(text_col).alias("_own_text"))


def encode_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit) of each document."""
    got = _encoded(_renamed(docs, id_col, text_col), "_own_id", "_own_text", path or default_tokenizer(), block, leaf, window, "ids binary", lambda _, ids: [pa.array(ids, pa.binary())])
    return got.select(F.col("_own_id").alias(id_col), "ids")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256."""

    def digest(codec: _Codec, rows: list[bytes]) -> list[pa.Array]:
        counts, own, text = [], [], []
        for raw in rows:
            counts.append(len(raw) // 4)
            own.append(hashlib.sha256(raw).hexdigest())
            text.append(hashlib.sha256(codec.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(own, pa.string()), pa.array(text, pa.string())]

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    got = _encoded(_renamed(docs, id_col, text_col), "_own_id", "_own_text", path or default_tokenizer(), block, leaf, window, fields, digest)
    return got.select(F.col("_own_id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


def decode_frame(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Decode little-endian unsigned 32-bit ids, special tokens included: id, text.  Null ids decode to the empty text."""
    path = path or default_tokenizer()

    def decoder() -> Callable[[list[bytes | None]], list[pa.Array]]:
        codec = _Codec.of(path)
        return lambda rows: [pa.array([codec.decode(np.frombuffer(x or b"", "<u4")) for x in rows], pa.string())]

    return map_texts(encoded.select(id_col, ids_col), [id_col], ids_col, "text string", decoder)
