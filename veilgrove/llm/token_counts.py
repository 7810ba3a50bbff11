"""Token counts by section, from one encoding of the whole text.

Encoding sections apart would change tokens at their edges and count them
wrongly.  Here a text is encoded once, whole; every token's character span
follows from the byte lengths of the tokens before it (the vocabulary is
byte-level, so the tokens' bytes are the text's bytes); and the spans are
interval-joined to the sections, both sides being sorted, by binary search.

A token that lies over an edge is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, and of equal
  ones to the earlier;
* ``share``: to each section by the share of its characters there.

Sections are the lines of the text, each with the newline that ends it; the
first line with a non-blank character is the title, lines without one are blank,
all others are body.  ``attribute`` takes any other sorted, gapless sections.

Defined cases: a null text is the empty one, with no token and one empty blank
section; repeated rows give repeated rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilgrove.llm.common import map_texts, text_or_empty

RULES = ("start", "majority", "share")
TITLE, BODY, BLANK = 0, 1, 2
#: White space of this length is encoded apart, as the one pre-token it is: the library's pattern would overflow its stack.
_WIDE = re.compile(r"\s{20000,}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the whole text, and the byte at which each token starts (with the text's length at the end)."""
    enc, lengths = _encoding(path or default_ranks())
    out, at = [], 0
    for m in _WIDE.finditer(text):
        end = m.end() - (m.end() < len(text))  # the last blank goes with what follows
        out += [*enc.encode_ordinary(text[at : m.start()]), *enc._encode_single_piece(text[m.start() : end])]
        at = end
    ids = np.array(out + enc.encode_ordinary(text[at:]), np.int64)
    return ids, np.concatenate([[0], np.cumsum(lengths[ids])])


def token_spans(text: str, path: str | None = None) -> list[tuple[int, int, int]]:
    """(id, start, end) of each token in characters: from that of its first byte to that of its last, end exclusive."""
    ids, edges = encode(text, path)
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)
    return [(int(i), int(char[a] - 1), int(char[b - 1])) for i, a, b in zip(ids, edges, edges[1:], strict=False)]


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines of a text, and their kinds."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1])
    kinds = np.array([BODY if x.strip() else BLANK for x in raw.split(b"\n")])
    if len(body := np.flatnonzero(kinds == BODY)):
        kinds[body[0]] = TITLE
    return starts, kinds


def attribute(edges: np.ndarray, starts: np.ndarray, raw: bytes, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross an edge.

    ``edges`` are the tokens' bytes as from ``encode``; ``starts`` the sections'
    first bytes, rising from 0, empty sections allowed.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    first = np.searchsorted(starts, edges[:-1], "right") - 1
    last = np.searchsorted(starts, edges[1:] - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    if rule == "start" or not len(crossing):
        return np.bincount(first, minlength=len(starts)).astype(float), len(crossing)
    inside = first == last
    out = np.bincount(first[inside], minlength=len(starts)).astype(float)
    for k in crossing.tolist():
        a, b = int(edges[k]), int(edges[k + 1])
        own = range(first[k], last[k] + 1)
        cuts = [a, *(int(starts[s]) for s in own[1:]), b]
        n = [sum(x & 0xC0 != 0x80 for x in raw[i:j]) or 1e-9 for i, j in zip(cuts, cuts[1:], strict=False)]
        if rule == "majority":
            out[own[max(range(len(n)), key=lambda i: (n[i], -i))]] += 1
        else:
            for s, part in zip(own, n, strict=True):
                out[s] += part / sum(n)
    return out, len(crossing)


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", path: str | None = None) -> DataFrame:
    """id, n_tokens, n_sections, n_crossing, title_tokens, body_tokens, blank_tokens, section_tokens (per line, in order)."""
    path = path or default_ranks()

    def make() -> Callable[[list[str]], list[pa.Array]]:
        def apply(texts: list[str]) -> list[pa.Array]:
            rows = []
            for t in texts:
                raw = t.encode()
                _, edges = encode(t, path)
                starts, kinds = lines(raw)
                per, crossing = attribute(edges, starts, raw, rule)
                by = np.bincount(kinds, per, minlength=3)
                rows.append((len(edges) - 1, len(starts), crossing, *by.tolist(), per.tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return [*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:6]), pa.array(cols[6], pa.list_(pa.float64()))]

        return apply

    return map_texts(text_or_empty(docs, id_col, text_col), [id_col], text_col, "n_tokens bigint, n_sections bigint, n_crossing bigint, title_tokens double, body_tokens double, blank_tokens double, section_tokens array<double>", make)
