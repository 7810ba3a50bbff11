"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. ``fit`` learns two logistic heads (quality, toxicity) on a bounded sample of
   labelled rows: at most ``sample`` of them (``SAMPLE`` by default), those with
   the smallest hashes of their ids.  A lexicon for the second head is learned
   from the same rows: the words that toxic documents use most beyond others.
2. Over *all* documents, grouped aggregation adds up the documents' quality
   evidence by host and by path on a host.  Beta priors are fitted by moments:
   hosts are shrunk towards the global mean, paths towards their host, sparse
   ones the more.
3. A document's posterior odds are the likelihood ratio of its own evidence
   times the odds of its path's posterior.

A document is kept where that posterior is at least ``KEEP`` and the toxicity
head stays below ``TOXIC``.

Defined cases: a null text is the empty one; a null host or path is the empty
string, a site like any other; without labelled rows of both classes a head is
neutral (0.5, or 0 for toxicity) and rejects nothing; repeated rows count as
often as they come, but a labelled id counts once in fitting; an empty table
gives no rows; columns of the input that bear the name of a result are replaced
by it, unless ``prefix`` gives the results other names, and all others stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import bounded_batches, cut, ddl, free
from veilgrove.llm.rules import STOP_WORDS

#: Labelled rows to fit on, at most; words of the lexicon, at most.
SAMPLE, LEXICON = 20_000, 300
#: A wrong rejection costs three times what a wrong keep does, hence a quarter.
KEEP, TOXIC = 0.25, 0.5
RESULTS = ("doc_prob", "host_posterior", "path_posterior", "posterior", "toxic_prob", "kept")
#: Sites up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 50_000

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>~^={}\\"
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_EDGES = b".,;:!?\"'()[]*#$%&|<>"
FEATURES = ("log_words", "word_length", "symbols", "exclamations", "bars", "upper", "digits", "stop_words", "line_words", "distinct", "long_words")


def features(raw: bytes, words: list[bytes]) -> list[float]:
    """Ratios of a text that need no vocabulary but the stop words."""
    n, size = max(1, len(words)), max(1, len(raw))
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        math.log1p(len(words)),
        min(30.0, size / n),
        min(5.0, gone(_SYMBOLS) / n),
        min(5.0, raw.count(b"!") / n),
        min(5.0, raw.count(b"|") / n),
        gone(_UPPER) / size,
        gone(b"0123456789") / size,
        sum(map(_STOPS.__contains__, words)) / n,
        min(10.0, math.log1p(n / (1 + raw.count(b"\n")))),
        len(set(words)) / n,
        min(1.0, max(map(len, words), default=0) / 100),
    ]


def insults(words: list[bytes], lexicon: frozenset[bytes]) -> list[float]:
    """How often words of the lexicon come, at all and for each word."""
    if not lexicon:
        return [0.0, 0.0]
    hits = sum(w in lexicon or w.lower().strip(_EDGES) in lexicon for w in set(words))
    return [math.log1p(hits), min(1.0, 20 * hits / max(1, len(words)))]


class Head(NamedTuple):
    """A logistic model of standardised features; neutral without weights."""

    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    base_rate: float = 0.5

    def prob(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.base_rate)
        z = (x - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


class Model(NamedTuple):
    quality: Head
    toxic: Head
    lexicon: frozenset[bytes]


def logistic(x: np.ndarray, y: np.ndarray, neutral: float, penalty: float = 1.0, rounds: int = 25) -> Head:
    """Penalised maximum likelihood by Newton steps."""
    if len(set(y.tolist())) < 2:
        return Head(base_rate=neutral)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Head(tuple(mean), tuple(scale), tuple(w), float(y.mean()))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, toxic_col: str, sample: int) -> DataFrame:
    picked = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(quality_col).cast("int").alias("_quality"), F.col(toxic_col).cast("int").alias("_toxic"))
    picked = picked.withColumn("_label", F.xxhash64(id_col)).orderBy("_label", "_quality", "_toxic").limit(sample)  # the bound of what is broadcast
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(picked), id_col).drop(id_col)


def lexicon(rows: DataFrame, size: int = LEXICON, support: float = 0.02, odds: float = 8.0) -> frozenset[bytes]:
    """Words in a share of at least ``support`` of the toxic documents, and in 5, and ``odds`` times as likely there as elsewhere."""
    n = rows.agg(F.sum("_toxic"), F.sum(1 - F.col("_toxic"))).first()
    if not n[0] or not n[1]:
        return frozenset()
    words = rows.where(F.col("_toxic").isNotNull()).select("_toxic", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}\p{M}'’-]+"))).alias("word")).where("word <> ''")
    by = words.groupBy("word").agg(F.sum("_toxic").alias("bad"), F.sum(1 - F.col("_toxic")).alias("other")).where(F.col("bad") >= max(5, support * n[0]))
    ratio = ((F.col("bad") + 0.5) / (n[0] + 1)) / ((F.col("other") + 0.5) / (n[1] + 1))
    top = by.where(ratio >= odds).orderBy(F.desc(ratio), "word").limit(size).select("word").collect()
    return frozenset(r.word.encode() for r in top)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Both heads from at most ``sample`` labelled rows; what reaches the driver is bounded by it."""
    bounded_batches(docs.sparkSession)
    rows = _labelled(docs, labels, id_col, text_col, quality_col, toxic_col, sample)
    words = lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_both(t, words) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_label"), b.column("_quality"), b.column("_toxic"), pa.array(x, pa.list_(pa.float64()))], names=["label", "q", "t", "x"])

    # One row for each label, however many rows bear its id: so many reach the driver, not more.
    got = rows.mapInArrow(run, "label bigint, q int, t int, x array<double>").groupBy("label", "q", "t").agg(F.min("x").alias("x")).toArrow().to_pydict()
    x = np.array(got["x"], float).reshape(-1, len(FEATURES) + 2)
    q, t = (np.array([-1 if v is None else v for v in got[k]]) for k in "qt")
    order = np.lexsort((*x.T, t, q))  # sums must not depend on the order of rows
    x, q, t = x[order], q[order], t[order]
    return Model(logistic(x[q >= 0, : len(FEATURES)], q[q >= 0], 0.5), logistic(x[t >= 0, len(FEATURES) :], t[t >= 0], 0.0), words)


def _both(text: str, words: frozenset[bytes]) -> list[float]:
    raw = text.encode()
    split = raw.split()
    return features(raw, split) + insults(split, words)


def evidence(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and doc_prob, toxic_prob of each row by itself, their names behind ``prefix``."""
    names = [f"{prefix}doc_prob", f"{prefix}toxic_prob"]
    docs = docs.drop(*names)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(FEATURES)
        for b in batches:
            x = np.array([_both(t or "", model.lexicon) for t in b.column(text_col).to_pylist()], float).reshape(-1, n + 2)
            more = [pa.array(np.round(model.quality.prob(x[:, :n]), 9)), pa.array(np.round(model.toxic.prob(x[:, n:]), 9))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, f"{ddl(docs, *docs.columns)}, " + ", ".join(f"`{c}` double" for c in names))


# -- the hierarchy ------------------------------------------------------------------------------
def strength(mean: float | None, between: float | None) -> float:
    """Pseudo-counts of the Beta prior with this mean and variance between sites, from 2 to 10,000."""
    if mean is None or between is None or between <= 0 or not 0 < mean < 1:
        return 10_000.0
    return min(10_000.0, max(2.0, mean * (1 - mean) / between - 1))


def sites(scored: DataFrame) -> DataFrame:
    """_host, _path, host_posterior, path_posterior from _host, _path, doc_prob.

    Sums are taken in whole billionths, so they are the same in any order.  The
    variance between sites is the weighted variance of their means less what
    sampling alone would give.
    """
    unit = F.sum(F.round(F.col("doc_prob") * 1e9).cast("decimal(38,0)"))
    paths = cut(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), unit.alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def spread(groups: DataFrame, n: str, s: str, centre: Column) -> tuple:
        m = (F.col(s) / 1e9 / F.col(n)).cast("double")
        got = groups.agg(F.sum(n), F.sum(F.col(n) * (m - centre) ** 2), F.count("*")).first()
        return got

    total = hosts.agg((F.sum("hs") / 1e9).cast("double"), F.sum("hn")).first()
    mean = min(1 - 1e-6, max(1e-6, total[0] / total[1])) if total[1] else 0.5

    def prior(n, dev, groups) -> float:
        if not n or groups < 2:
            return strength(None, None)
        return strength(mean, max(0.0, (dev - (groups - 1) * mean * (1 - mean)) / n))

    k_host = prior(*spread(hosts, "hn", "hs", F.lit(mean)))
    posterior = lambda s, n, k, m: ((F.col(s) / 1e9).cast("double") + k * m) / (F.col(n) + k)
    both = paths.join(hosts.withColumn("host_posterior", posterior("hs", "hn", F.lit(k_host), F.lit(mean))), "_host")
    k_path = prior(*spread(both, "n", "s", F.col("host_posterior")))
    return both.select("_host", "_path", "host_posterior", posterior("s", "n", F.lit(k_path), F.col("host_posterior")).alias("path_posterior"))


def classify(docs: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and RESULTS, their names behind ``prefix``.

    The text is read twice and never shuffled: once for the sums by site, and
    once to join each row's evidence with its site's posterior.
    """
    results = {c: f"{prefix}{c}" for c in RESULTS}
    docs = docs.drop(*results.values())
    h, p = free(docs, "_host"), free(docs, "_path")
    keyed = docs.withColumns({h: F.coalesce(host.cast("string"), F.lit("")), p: F.coalesce(path.cast("string"), F.lit(""))})
    by_site = cut(sites(evidence(keyed.select(F.col(h).alias("_host"), F.col(p).alias("_path"), text_col), model, text_col)))
    by_site = by_site.select(F.col("_host").alias(h), F.col("_path").alias(p), *[F.col(c).alias(results[c]) for c in ("host_posterior", "path_posterior")])
    if by_site.count() <= BROADCAST_SITES:
        by_site = F.broadcast(by_site)
    logit = lambda x: F.log(x / (1 - x))
    clip = lambda c: F.least(F.greatest(F.col(results[c]), F.lit(1e-9)), F.lit(1 - 1e-9))
    base = min(1 - 1e-6, max(1e-6, model.quality.base_rate))
    odds = logit(clip("doc_prob")) - math.log(base / (1 - base)) + logit(clip("path_posterior"))
    scored = evidence(keyed.join(by_site, [h, p]), model, text_col, prefix).withColumn(results["posterior"], F.round(1 / (1 + F.exp(-odds)), 9) if model.quality.weights else F.lit(0.5))
    kept = (F.col(results["posterior"]) >= KEEP) & (F.col(results["toxic_prob"]) < TOXIC)
    return scored.withColumn(results["kept"], kept).select(*docs.columns, *results.values())
