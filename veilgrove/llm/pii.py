"""Personal data: candidate spans scored by gradient-boosted trees, all in Catalyst.

Generators with high recall propose spans, overlapping ones too.  Four of them
are the base kinds, whose matches stay if they pass their checks.  The spans of
the others are scored by small boosted trees over features of their format and
of the text around them; the trees are compiled into CASE expressions, and each
kind has a threshold that was calibrated for precision on sequences kept apart
from fitting.  Training texts are generated with a fixed seed and sent through
the very same expressions, so a feature has one definition.

Everything happens inside the row: no user function, no shuffle.  Places come
from splitting a text by a generator's pattern: the gaps and the matches, in
turn, make up the text, so starts are running sums of lengths in code points.
Running sums and maxima are blocked (``_running``), so the work is in proportion
to a text's matches.  The text around a candidate is the last 40 characters of
the gap before it and the first 12 of the gap after it, gaps being those between
matches of the same kind.
Patterns are written so that Java's engine neither recurses nor restarts inside
a run: possessive repeats, and starts only where a run starts or a match ended.

Defined cases: a null text is the empty one, without spans; ends are exclusive;
spans that start together come in the listed order of kinds; an added span that
lies within a span already kept is left out; repeated rows give repeated rows;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove.llm.common import text_or_empty


class Generator(NamedTuple):
    """A kind, its pattern, the SQL condition on ``t`` without which it has no match, and the check of a match ``c.x``."""

    kind: str
    pattern: str
    gate: str
    check: str = "true"


_LOCAL = "A-Za-z0-9._%+-"
_DIGITS = "regexp_replace(c.x, '[^0-9]', '')"
_COUNT = f"length({_DIGITS})"
_LUHN = (
    f"aggregate(sequence(1, {_COUNT}), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substring(reverse({_DIGITS}), i, 1)) "
    f"ELSE int(substring('0246813579', int(substring(reverse({_DIGITS}), i, 1)) + 1, 1)) END) % 10 = 0"
)
BASE = (
    Generator("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "d", r"forall(split(c.x, '[.]'), p -> CASE WHEN length(ltrim('0', p)) > 3 THEN false ELSE int(concat('0', ltrim('0', p))) <= 255 END)"),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", "d", f"CASE WHEN {_COUNT} BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", f"{_COUNT} BETWEEN 10 AND 15"),
)
MORE = (
    Generator("phone_local", r"(?<![0-9])[(]?[0-9]{3}[)]?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "d"),
    Generator("social", r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])", "d"),
    Generator("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "d"),
    Generator("email_hidden", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++", "contains(lower(t), '(at)') OR contains(lower(t), '[at]')"),
    Generator("device", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", "d"),
    Generator("number", r"(?<![0-9.,+$#-])[0-9](?:[\x20./-]?[0-9]){7,19}(?![0-9])", "d"),
)
KINDS = tuple(g.kind for g in BASE + MORE)

#: Name and SQL of each feature of a candidate ``c``: kind, text x, the text before and after it.
FEATURES = {
    "digits": _COUNT,
    "length": "length(c.x)",
    "blanks": "length(c.x) - length(replace(c.x, ' ', ''))",
    "hyphens": "length(c.x) - length(replace(c.x, '-', ''))",
    "points": "length(c.x) - length(replace(replace(c.x, '.', ''), '/', ''))",
    "upper": "length(regexp_replace(c.x, '[^A-Z]', ''))",
    "distinct_digits": f"size(array_distinct(split({_DIGITS}, '')))",
    "joined_before": "int(c.pre RLIKE '[A-Za-z0-9_/=.-]$')",
    "joined_after": "int(c.post RLIKE '^[A-Za-z0-9_/=%-]')",
    "money_before": "int(c.pre RLIKE '[$€£]\\\\s?$')",
    "unit_after": "int(c.post RLIKE '^\\\\s?(%|kg|km|cm|mm|GB|MB|USD|EUR|rows|units|people|copies|users|times|years|items|words|pages|dollars|euros)')",
    "call": "int(lower(c.pre) RLIKE '(phone|tel|call|mobile|cell|fax|whatsapp|t[eé]l[eé]fon)')",
    "identity": "int(lower(c.pre) RLIKE '(ssn|social|passport|licen[cs]e|national|identity|dni|ausweis)')",
    "bank": "int(lower(c.pre) RLIKE '(iban|account|bank|konto|compte|cuenta|card|swift)')",
    "contact": "int(lower(c.pre) RLIKE '(mail|contact|write|reach|kontakt)')",
    "machine": "int(lower(c.pre) RLIKE '(mac|device|ethernet|wlan|bluetooth)')",
    "counted": "int(lower(c.pre) RLIKE '(order|invoice|item|part|isbn|issn|version|page|serial|sku|total|date|born|id)\\\\W*$')",
    "counted_near": "int(lower(c.pre) RLIKE '(order|invoice|item|part|isbn|issn|serial|sku|total|sum|about|around|nearly|over|cost|count|version|page)\\\\W+(\\\\w+\\\\W+){0,2}$')",
    **{f"is_{g.kind}": f"int(c.k = {len(BASE) + k})" for k, g in enumerate(MORE)},
}


# -- boosted trees -------------------------------------------------------------------------------
class Leaf(NamedTuple):
    value: float


class Split(NamedTuple):
    feature: str
    cut: float
    low: Leaf | Split
    high: Leaf | Split


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, names: list[str], depth: int, rate: float, ridge: float = 1.0, least: float = 2.0) -> Leaf | Split:
    """Tree of second-order gain, exact cuts between seen values."""
    score = lambda a, b: a * a / (b + ridge)
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                gl, hl = g[low].sum(), h[low].sum()
                if hl < least or h.sum() - hl < least:
                    continue
                gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - score(g.sum(), h.sum())
                if gain > best[0]:
                    best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return Leaf(round(float(rate * g.sum() / (h.sum() + ridge)), 6))
    low = x[:, f] <= cut
    return Split(names[f], float(cut), *(_grow(x[m], g[m], h[m], names, depth - 1, rate) for m in (low, ~low)))


def value(tree: Leaf | Split, row: dict[str, float]) -> float:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.cut else tree.high
    return tree.value


def tree_sql(tree: Leaf | Split, of: str = "f") -> str:
    if isinstance(tree, Leaf):
        return f"{tree.value!r}D"
    return f"CASE WHEN {of}.{tree.feature} <= {tree.cut!r}D THEN {tree_sql(tree.low, of)} ELSE {tree_sql(tree.high, of)} END"


class Booster(NamedTuple):
    bias: float
    trees: tuple[Leaf | Split, ...]
    #: Least score for a span of each added kind.
    thresholds: dict[str, float]

    def score(self, row: dict[str, float]) -> float:
        return self.bias + sum(value(t, row) for t in self.trees)


def boost(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Booster:
    base = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    bias, trees = round(float(np.log(base / (1 - base))), 6), []
    margin = np.full(len(y), bias)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), names, depth, rate)
        trees.append(tree)
        margin = margin + np.array([value(tree, dict(zip(names, r, strict=True))) for r in x.tolist()])
    return Booster(bias, tuple(trees), {})


def calibrate(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """A score from which on a share of ``precision`` is right: halfway to the next lower one, or well below all if none is left out; infinite where none is."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(y) else np.empty(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return float("inf")
    least, rest = float(scores[order][good[-1]]), scores[order][good[-1] + 1 :]
    return (least + float(rest[0])) / 2 if len(rest) else min(0.0, least - 2)


# -- candidates -----------------------------------------------------------------------------------
_SPAN = "array<struct<s:int,k:int,e:int,x:string,pre:string,post:string>>"


def _candidates(src: DataFrame, id_col: str, gens: tuple[Generator, ...], first: int) -> DataFrame:
    """``src`` (id, t, d) and c_<kind>: the kind's matches with places and the text around them."""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    keep = src.columns
    cuts = []
    for g in gens:
        cuts.append(F.expr(f"CASE WHEN {g.gate} THEN regexp_extract_all(t, '{quote(g.pattern)}', 0) ELSE cast(array() AS array<string>) END").alias(f"m_{g.kind}"))
        cuts.append(F.expr(f"CASE WHEN {g.gate} THEN split(t, '{quote(g.pattern)}', -1) ELSE cast(array() AS array<string>) END").alias(f"p_{g.kind}"))
    split = src.select(*keep, *cuts)
    lengths = [F.expr(f"transform(m_{g.kind}, (x, i) -> length(p_{g.kind}[i]) + length(x))").alias(f"l_{g.kind}") for g in gens]
    split = split.select("*", *lengths)
    split = split.select("*", *[_base(f"l_{g.kind}", "0", "+").alias(f"a_{g.kind}") for g in gens])

    def places(k: int, kind: str) -> Column:
        m, p = f"m_{kind}", f"p_{kind}"
        start = f"{_running(f'l_{kind}', f'a_{kind}', '0', '+')} + length({p}[i])"
        fields = f"'s', {start}, 'k', {k}, 'e', {start} + length(x), 'x', x, 'pre', right({p}[i], 40), 'post', left({p}[i + 1], 12)"
        return F.expr(f"transform({m}, (x, i) -> named_struct({fields}))")

    return split.select(*keep, *[places(k, g.kind).alias(f"c_{g.kind}") for k, g in enumerate(gens, first)])


#: Elements of a block of a running sum or maximum.
_BLOCK = 64


def _both(op: str, a: str, b: str) -> str:
    return f"{a} + {b}" if op == "+" else f"greatest({a}, {b})"


def _base(col: str, zero: str, op: str) -> Column:
    """What comes before each block of the array ``col``: a list of its blocks' running totals, short, so its growth by copies is cheap."""
    total = f"aggregate(slice({col}, b * {_BLOCK} + 1, {_BLOCK}), {zero}, (u, v) -> {_both(op, 'u', 'v')})"
    step = f"named_struct('a', concat(acc.a, array(acc.t)), 't', {_both(op, 'acc.t', total)})"
    blocks = f"sequence(0, (size({col}) - 1) div {_BLOCK})"
    return F.expr(f"CASE WHEN size({col}) = 0 THEN cast(array() AS array<int>) ELSE aggregate(transform({blocks}, b -> cast(b AS int)), named_struct('a', cast(array() AS array<int>), 't', {zero}), (acc, b) -> {step}, acc -> acc.a) END")


def _running(col: str, base: str, zero: str, op: str) -> str:
    """SQL of the sum or maximum of the elements of ``col`` before place ``i``."""
    return f"aggregate(slice({col}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), element_at({base}, cast(i div {_BLOCK} AS int) + 1), (u, v) -> {_both(op, 'u', 'v')})"


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = text_or_empty(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return src.withColumn("d", F.col("t").rlike("[0-9]"))


def _scored(src: DataFrame, more: tuple[Generator, ...]) -> DataFrame:
    """Adds f: the added kinds' candidates with their features."""
    with_more = _candidates(src, "id", more, len(BASE))
    both = with_more.select(*src.columns, F.concat(*[F.col(f"c_{g.kind}") for g in more]).alias("c_more"))
    fields = ", ".join(f"'{n}', double({sql})" for n, sql in FEATURES.items())
    return both.select(*src.columns, F.expr(f"transform(c_more, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, {fields}))").alias("f"))


def training_texts(n: int = 700, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts, and the personal spans in them."""
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("the and er on ti ing re ou ha le de la un que ver ung sch os para con".split()) for _ in range(rng.randint(1, 3)))
    fill = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += fill(2, 6) + " "
            kind = rng.randrange(16)
            s = {
                0: lambda: f"({d(3)}) {d(3)}-{d(4)}", 1: lambda: pick([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]), 2: lambda: f"{d(3)}-{d(2)}-{d(4)}", 3: lambda: pick(["DE", "FR", "ES", "GB"]) + d(2) + "".join(" " + d(4) for _ in range(4)),
                4: lambda: f"{word()}.{d(2)} [at] {word()}.example{pick(['.', ' (dot) '])}com", 5: lambda: pick(":-").join(pick("0123456789abcdef") + pick("0123456789abcdef") for _ in range(6)), 6: lambda: d(rng.choice([8, 9, 10, 11])),
            }.get(kind)
            if s:
                s = s()
                lead = [["phone ", "call ", "Tel: ", "mobile ", "phone number is ", ""], ["phone: ", "fax ", "cell ", "mobile is ", ""], ["SSN ", "social security ", "social security number is ", ""], ["IBAN ", "account ", "Konto ", "account is ", ""], ["write to ", "mail ", ""], ["MAC ", "device ", "ethernet address was ", ""], ["passport ", "national id ", "identity card ", "Tel. ", "passport number is "]][kind]
                head = pick(lead)
                spans.append((len(text) + len(head), len(text) + len(head) + len(s)))
                text += head + s + pick([" ", ". ", ", "])
            else:
                text += pick([
                    lambda: f"order {d(3)} {d(3)} {d(4)} ", lambda: f"invoice {d(8)}", lambda: f"${d(3)},{d(3)} ", lambda: f"{d(4)}-{d(2)}-{d(2)} ", lambda: f"isbn {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)} ", lambda: f"x{d(9)}y ",
                    lambda: f"part {d(3)}-{d(2)}-{d(4)} ", lambda: f"total {d(9)} rows ", lambda: f"{d(2)}/{d(2)}/{d(4)} ", lambda: f"v{d(1)}.{d(2)}.{d(4)} ", lambda: f"{d(12)} ", lambda: f"{pick(['about', 'nearly', 'over'])} {d(3)} {d(3)} {d(3)} {pick(['people', 'copies', word()])} ", lambda: f"{pick(['total', 'sum', 'count'])} {pick(['was', 'of', 'is'])} {d(rng.choice([8, 9, 10]))} ", lambda: f"order {pick(['no', 'number', ''])} {d(8)} ", lambda: f"serial AB{d(2)} {d(4)} {d(4)} ",
                ])()
        out.append((text + fill(1, 4), spans))
    return out


_FITTED: dict[tuple, Booster] = {}


def fit(spark: SparkSession, n: int = 700, precision: float = 0.95) -> Booster:
    """Trees fitted on generated texts, thresholds calibrated on others; a few thousand rows reach the driver."""
    if (n, precision) in _FITTED:
        return _FITTED[n, precision]
    parts = []
    for seed in (11, 12):
        texts = training_texts(n, seed)
        rows = spark.range(1, numPartitions=1).select(F.posexplode(F.array(*[F.lit(t) for t, _ in texts])).alias("id", "t")).withColumn("d", F.lit(True))
        got = _scored(rows, MORE).select("id", F.explode("f").alias("f")).select("id", "f.*").collect()
        got = sorted((r.asDict() for r in got), key=lambda r: (r["id"], r["s"], r["k"], r["e"]))
        y = np.array([float(any(a < r["e"] and r["s"] < b and r["s"] - 1 <= a and r["e"] >= b - 1 for a, b in texts[r["id"]][1])) for r in got])
        parts.append((got, np.array([[r[f] for f in FEATURES] for r in got]), y))
    (_, x, y), (held, hx, hy) = parts
    model = boost(x, y, list(FEATURES))
    scores = np.array([model.score(r) for r in held])
    kinds = np.array([r["k"] for r in held])
    limits = {g.kind: calibrate(scores[kinds == k], hy[kinds == k], precision) for k, g in enumerate(MORE, len(BASE))}
    _FITTED[n, precision] = model._replace(thresholds=limits)
    return _FITTED[n, precision]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Booster | None = None) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_more, base (joined base spans), spans (all spans, joined)."""
    model = model or fit(docs.sparkSession)
    src = _candidates(_prepared(docs, id_col, text_col), "id", BASE, 0)
    checked = src.select("id", "t", "d", *[F.expr(f"transform(filter(c_{g.kind}, c -> {g.check}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))").alias(f"b_{g.kind}") for g in BASE])
    scored = _scored(checked, MORE)
    total = " + ".join([f"{model.bias!r}D", *(tree_sql(t) for t in model.trees)])
    limit = "CASE f.k " + " ".join(f"WHEN {k} THEN {model.thresholds[g.kind]!r}D" for k, g in enumerate(MORE, len(BASE)) if model.thresholds.get(g.kind, float("inf")) < float("inf")) + " ELSE 1e308D END"
    chosen = F.expr(f"transform(filter(f, f -> {total} >= {limit}), f -> named_struct('s', f.s, 'k', f.k, 'e', f.e))")
    base = F.sort_array(F.concat(*[F.col(f"b_{g.kind}") for g in BASE]))
    picked = scored.select("id", *[F.size(f"b_{g.kind}").cast("long").alias(f"n_{g.kind}") for g in BASE], base.alias("b"), chosen.alias("m"))
    # In order of start and kind, an added span is kept if it goes beyond all spans before it, kept or not: those left out end no later than one that is kept.
    picked = picked.withColumn("o", F.sort_array(F.concat("b", "m"))).withColumn("e", F.transform("o", lambda x: x["e"])).withColumn("g", _base("e", "-1", "max"))
    merged = F.expr(f"filter(o, (x, i) -> x.k < {len(BASE)} OR x.e > {_running('e', 'g', '-1', 'max')})")
    counts = [f"n_{g.kind}" for g in BASE]
    kept = picked.select("id", *counts, "b", F.when(F.size("m") == 0, F.col("b")).otherwise(merged).alias("a"))
    return kept.select(F.col("id").alias(id_col), *counts, (F.size("a") - F.size("b")).cast("long").alias("n_more"), _joined("b").alias("base"), _joined("a").alias("spans"))


def _joined(col: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({col}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")
