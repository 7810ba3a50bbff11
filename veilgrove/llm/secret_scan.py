"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as outside (O), beginning (B) or inside (I) a secret.  Its
features are the shape of a token, the shapes of the three tokens before and the
one after, and two features of the whole text (how much of it looks like code).
Weights are fitted in seconds, on sequences generated from templates with a
fixed seed, by gradient steps on the exact log-likelihood from forward and
backward sums; decoding is Viterbi.

The field has one hard constraint: a token further than ``REACH`` tokens from
every lively one (a digit, a keyword, a known opening, twenty characters or
more) is outside.  The constraint cuts a text into stretches with fixed O
between them, and Viterbi over each stretch is Viterbi over the whole text.

Defined cases: a null text is the empty one, without spans; spans are in code
points with exclusive ends; of spans that start together the patterns come
first, in the listed order; repeated rows give repeated rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilgrove.llm.common import map_texts, text_or_empty

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUE = ("password", "passwd", "secret", "token", "api")

# -- tokens and their shapes --------------------------------------------------------------
#: Words with what joins them inside keys; an equals sign belongs to a token only as padding at its end.
_TOKEN = re.compile(r"[A-Za-z0-9_]+(?:[+/.-]+[A-Za-z0-9_]+)*(?:[+/]*={1,2}(?![A-Za-z0-9_=\"'+/]))?|[^\sA-Za-z0-9_]")
_DIGIT = re.compile(r"[0-9]")
#: Words that announce a secret, and the openings of well-known keys.
_KEYWORDS = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "auth", "bearer", "credential", "private_key", "access_key", "signature")
_OPENINGS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat", "sk-", "sk_", "pk_", "rk_", "xox", "AIza", "eyJ", "glpat-", "ya29.", "SG.", "hf_", "npm_")
SHAPES = (
    "word", "upper", "punct", "equals", "colon", "quote", "at", "slash_or_angle", "keyword", "opening",
    "digits", "has_digit", "mixed", "all_hex", "long_8", "long_16", "long_20", "long_32", "varied", "many_switches", "dotted", "other_symbol", "plus_or_paren", "noise",
)
_AT = {name: k for k, name in enumerate(SHAPES)}
OFFSETS = (0, -1, -2, -3, 1)
TEXT_FEATURES = ("code", "prose")
REACH = 4
_LABELS = 3  # O, B, I


def _shape(token: str) -> int:
    """The shape of a token as a bit mask over SHAPES."""
    on = []
    if len(token) == 1 and not token.isalnum() and token != "_":
        on.append("punct")
        on.append({"=": "equals", ":": "colon", '"': "quote", "'": "quote", "`": "quote", "@": "at", "/": "slash_or_angle", "<": "slash_or_angle", ">": "slash_or_angle", "+": "plus_or_paren", "(": "plus_or_paren", ")": "plus_or_paren", "*": "noise", "&": "noise", "|": "noise"}.get(token, "other_symbol"))
    else:
        low = token.lower()
        digits = sum(c in "0123456789" for c in token)
        letters = sum(c.isalpha() for c in token)
        if not digits:
            on.append("word")
        if token.isupper():
            on.append("upper")
        if any(k in low for k in _KEYWORDS):
            on.append("keyword")
        if token.startswith(_OPENINGS):
            on.append("opening")
        if digits:
            on.append("has_digit")
        if digits and not letters:
            on.append("digits")
        if digits and letters:
            on.append("mixed")
        if digits and re.fullmatch("[0-9a-fA-F]+", token):
            on.append("all_hex")
        n = len(token)
        on += [f"long_{k}" for k in (8, 16, 20, 32) if n >= k]
        if n >= 8 and -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.0:
            on.append("varied")
        kind = ["d" if c in "0123456789" else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in token]
        if sum(a != b for a, b in zip(kind, kind[1:], strict=False)) >= 4:
            on.append("many_switches")
        if "." in token or "-" in token or "/" in token:
            on.append("dotted")
    return sum(1 << _AT[x] for x in on)


#: Shapes of lively tokens.
_LIVELY = sum(1 << _AT[x] for x in ("keyword", "opening", "has_digit", "long_20"))


class _Shapes(dict):
    def __missing__(self, token: str) -> int:
        got = _shape(token)
        if len(token) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[token] = got
        return got


def _text_features(text: str) -> np.ndarray:
    code = sum(map(text.count, "{};=()[]"))
    share = code / max(1, len(text))
    return np.array([share > 0.03, share < 0.005], float)


# -- the field -------------------------------------------------------------------------------
class Field(NamedTuple):
    """weights: offset, shape, label; file: text feature, label; step: from label, to label; bias, first: label."""

    weights: np.ndarray
    file: np.ndarray
    step: np.ndarray
    bias: np.ndarray
    first: np.ndarray

    def scores(self, shapes: list[int], text_features: np.ndarray) -> np.ndarray:
        """Score of each label at each token of a stretch; tokens beyond its ends have no shape."""
        bits = _unpack(shapes)
        out = bits @ self.weights[0] + self.bias + text_features @ self.file
        for k, d in enumerate(OFFSETS[1:], 1):
            part = bits @ self.weights[k]
            if -d >= len(bits):
                continue
            if d < 0:
                out[-d:] += part[:d]
            else:
                out[:-d] += part[d:]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0] + self.first, []
        for row in scores[1:]:
            via = best[:, None] + self.step
            back.append(via.argmax(0))
            best = via.max(0) + row
        at = [int(best.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return at[::-1]


def _unpack(shapes: list[int]) -> np.ndarray:
    return (np.array(shapes, np.int64)[:, None] >> np.arange(len(SHAPES)) & 1).astype(float)


def training_sequences(n: int = 700, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts and the spans of the secrets in them."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = "the and er on ti ing re ou ha le de la un que ver ung sch os ción es para con mit ein".split()
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    run = lambda chars, a, b: "".join(pick(chars) for _ in range(rng.randint(a, b)))

    def secret() -> str:
        kind = pick([0, 0, 1, 1, 2, 2, 3, 4, 5, 6])
        if kind == 0:
            return pick(_OPENINGS) + run(alnum, 16, 40)
        if kind == 1:
            return run("0123456789abcdef", 24, 48)
        if kind == 2:
            return run(alnum, 20, 44)
        if kind == 3:
            return run(alnum + "+/", 24, 60) + pick(["", "=", "=="])
        if kind == 4:
            return run(alnum, 2, 5) + pick("!@#$%") + run(alnum, 3, 6) + pick("!@#$%") + run("0123456789", 2, 4)
        if kind == 5:
            return "eyJ" + run(alnum, 12, 20) + "." + run(alnum, 16, 30) + "." + run(alnum, 16, 30)
        return run(alnum, 8, 14) + run("0123456789", 2, 4)

    def decoy() -> str:
        kind = rng.randrange(16)
        d = lambda a, b: run("0123456789", a, b)
        return [
            lambda: d(1, 6), lambda: f"{d(4, 4)}-{d(2, 2)}-{d(2, 2)}", lambda: f"{d(1, 3)}.{d(1, 3)}.{d(1, 3)}.{d(1, 3)}", lambda: d(16, 16),
            lambda: f"+1 ({d(3, 3)}) {d(3, 3)}-{d(4, 4)}", lambda: f"{word()}.{d(2, 2)}@mail{d(1, 1)}.example.com", lambda: f"https://{word()}.example.org/{word()}/{d(2, 4)}",
            lambda: f"v{d(1, 1)}.{d(1, 2)}.{d(1, 2)}", lambda: "".join(pick(syllables) for _ in range(8)), lambda: f"{word()}_{d(1, 3)}",
            lambda: pick(["password", "token", "secret", "the key", "auth"]), lambda: f"{word()} = {word()}",
            lambda: f"{d(2, 2)}:{d(2, 2)}:{d(2, 2)}", lambda: f"{d(4, 4)}-{d(2, 2)}-{d(2, 2)} {pick(['at ', ''])}{d(2, 2)}:{d(2, 2)}:{d(2, 2)}", lambda: f"{word()}({word()}[{d(1, 2)}], {word()}_{d(1, 2)})", lambda: f"{word()}_{d(4, 8)}.{pick(['pdf', 'png', 'txt'])}",
        ][kind]()

    style = [""]

    def word() -> str:
        w = plain()
        return w.upper() + "!!" if style[0] == "!" else w + pick(["***", "###", "%%%", "&&&", "$$$"]) if style[0] == "#" else w + pick([" |", "", ""]) if style[0] == "|" else w + pick([""] * 12 + [".", ",", ")", "'s"])

    out = []
    for _ in range(n):
        text, spans = "", []
        style[0] = pick(["", "", "", "!", "#", "|"])
        for _ in range(rng.randint(1, 2)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.45:
                s = secret()
                lead = pick(["password", "PASSWORD", "token", "secret_key", "api_key", "Authorization", "passphrase", "client_secret", "pwd", "ACCESS_TOKEN", "export AUTH_SECRET"])
                form = rng.randrange(8)
                weak = len(s) < 19
                head, tail = [(f"{lead}=", ""), (f'{lead} = "', '"'), (f"{lead}: ", ""), (f"{lead} is ", ""), (f'{{"{lead}": "', '"}'), (f"{lead} = '", "'"), (f"{lead}: Bearer ", ""), ("", "")][form % 6 if weak else form]
                spans.append((len(text) + len(head), len(text) + len(head) + len(s)))
                text += head + s + tail + (pick(["***", "###", "%%%", "&&&", "$$$"]) if style[0] == "#" else "!!" if style[0] == "!" else "") + pick([" ", ". ", ", ", "\n", "; "])
            else:
                text += decoy() + (pick(["***", "###", "%%%", "&&&", "$$$"]) if style[0] == "#" else "!!" if style[0] == "!" else "") + pick([" ", ". ", ", ", "\n"])
        text += " ".join(word() for _ in range(2)) + pick(["", ".", "\n"])
        out.append((text, spans))
    return out


def labelled(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    shapes, labels = [], []
    for m in _TOKEN.finditer(text):
        inside = next((s for s in spans if s[0] <= m.start() < s[1]), None)
        shapes.append(_shape(m[0]))
        labels.append(0 if inside is None else 1 if m.start() == inside[0] else 2)
    return shapes, labels


@functools.lru_cache(maxsize=1)
def fit(n: int = 700, seed: int = 7, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a small penalty, by Adam steps over all sequences at once."""
    data = [(*labelled(t, s), _text_features(t)) for t, s in training_sequences(n, seed)]
    size, longest = len(data), max(len(x[0]) for x in data)
    width = len(SHAPES)
    x = np.zeros((size, longest, len(OFFSETS) * width + len(TEXT_FEATURES) + 1))
    y = np.zeros((size, longest), int)
    mask = np.zeros((size, longest), bool)
    for r, (shapes, labels, tf) in enumerate(data):
        t = len(shapes)
        bits = _unpack(shapes)
        mask[r, :t], y[r, :t] = True, labels
        x[r, :t, :width] = bits
        x[r, 1:t, width : 2 * width] = bits[:-1]
        x[r, 2:t, 2 * width : 3 * width] = bits[:-2]
        x[r, 3:t, 3 * width : 4 * width] = bits[:-3]
        x[r, : t - 1, 4 * width : 5 * width] = bits[1:]
        x[r, :t, 5 * width : -1], x[r, :t, -1] = tf, 1
    flat = x[mask]
    gold = np.eye(_LABELS)[y] * mask[..., None]
    pairs = mask[:, 1:, None, None]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    par = {"w": np.zeros((x.shape[2], _LABELS)), "step": np.zeros((_LABELS, _LABELS)), "first": np.zeros(_LABELS)}
    mean, var = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}
    lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
    for it in range(1, rounds + 1):
        score = np.zeros((size, longest, _LABELS))
        score[mask] = flat @ par["w"]
        fwd, bwd = np.zeros_like(score), np.zeros_like(score)
        fwd[:, 0] = score[:, 0] + par["first"]
        for t in range(1, longest):
            on = lse(fwd[:, t - 1, :, None] + par["step"], 1) + score[:, t]
            fwd[:, t] = np.where(mask[:, t, None], on, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = lse(par["step"] + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], on, 0)
        z = lse(fwd[:, -1], 1)
        prob = np.exp(np.where(mask[..., None], fwd + bwd - z[:, None, None], -np.inf))
        both = np.exp(np.where(pairs, fwd[:, :-1, :, None] + par["step"] + (score + bwd)[:, 1:, None, :] - z[:, None, None, None], -np.inf))
        grad = {"w": flat.T @ (gold - prob)[mask] / size, "step": (gold_step - both.sum((0, 1))) / size, "first": (gold[:, 0] - prob[:, 0]).sum(0) / size}
        for k in par:
            g = grad[k] - decay * par[k]
            mean[k], var[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * var[k] + 0.01 * g * g
            par[k] += rate * (mean[k] / (1 - 0.9**it)) / (np.sqrt(var[k] / (1 - 0.99**it)) + 1e-8)
    w = par["w"]
    return Field(w[: 5 * width].reshape(len(OFFSETS), width, _LABELS), w[5 * width : -1], par["step"], w[-1], par["first"])


# -- spans -----------------------------------------------------------------------------------
def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, kind, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUE):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def field_spans(text: str, field: Field, shapes: dict[str, int]) -> list[tuple[int, int, int]]:
    """Spans that the field tags, stretch by stretch around the lively tokens."""
    if not (_DIGIT.search(text) or max(map(len, text.split()), default=0) >= 20):
        low = text.lower()
        if not any(k in low for k in _KEYWORDS) and not any(k in text for k in _OPENINGS):
            return []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    masks = [shapes[text[a:b]] for a, b in tokens]
    out, at = [], 0
    lively = [k for k, m in enumerate(masks) if m & _LIVELY]
    tf = _text_features(text) if lively else None
    while at < len(lively):
        lo, hi = max(0, lively[at] - REACH), lively[at] + REACH + 1
        while at + 1 < len(lively) and lively[at + 1] - REACH <= hi:
            at += 1
            hi = lively[at] + REACH + 1
        at += 1
        lo_ctx, hi = max(0, lo - 3), min(hi, len(tokens))
        hi_ctx = min(len(tokens), hi + 1)
        scores = field.scores(masks[lo_ctx:hi_ctx], tf)[lo - lo_ctx : hi - lo_ctx]
        if lo:  # an O stands before
            scores[0] = scores[0] - field.first + field.step[0]
        start = end = None
        for k, label in enumerate([*field.viterbi(scores), 0], lo):
            if start is not None and label != 2:
                out.append((start, 3, end))
                start = None
            if label and start is None:
                start = tokens[k][0]
            if label:
                end = tokens[k][1]
    return out


def scan(text: str, field: Field, shapes: dict[str, int]) -> tuple[list, list]:
    """Base spans, and all spans: those of the field stay out where a base span already holds them."""
    base = base_spans(text)
    more = [s for s in field_spans(text, field, shapes) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return base, sorted(base + more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_crf, base (joined base spans), spans (all of them)."""
    field = fit()

    def make() -> Callable[[list[str]], list[pa.Array]]:
        shapes = _Shapes()

        def apply(texts: list[str]) -> list[pa.Array]:
            counts, base, spans = [], [], []
            for t in texts:
                b, s = scan(t, field, shapes)
                n = Counter(k for _, k, _ in s)
                counts.append([n[k] for k in range(4)])
                base.append(_joined(b))
                spans.append(_joined(s))
            return [*(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base, pa.string()), pa.array(spans, pa.string())]

        return apply

    return map_texts(text_or_empty(docs, id_col, text_col), [id_col], text_col, "n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base string, spans string", make)


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one."""
    out, at = [], 0
    for a, b in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans.split(",") if s):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()
