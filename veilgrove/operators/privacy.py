"""Defences: divergence bounds, randomised response with priors, and marks for repair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.functions import scalar as S


def lmir(counts: list[Column], entire: list[Column]) -> Column:
    """The larger divergence from the prior of a node's class shares and of its complement's."""
    n = S.total(entire)
    prior = [e / n for e in entire]
    return F.greatest(S.divergence(counts, prior), S.divergence([e - c for e, c in zip(entire, counts, strict=True)], prior))


def k_star(prior: list[float], epsilon: float) -> tuple[int, list[int]]:
    """How many of the likeliest labels to answer from, and all labels in that order (stable)."""
    order = sorted(range(len(prior)), key=lambda k: -prior[k])
    best, at, cum = 0.0, 1, 0.0
    for k, label in enumerate(order):
        cum += prior[label]
        w = math.exp(epsilon) / (math.exp(epsilon) + k) * cum
        if w > best:
            best, at = w, k + 1
    return at, order


def ranked(priors: Column) -> Column:
    """Labels of an array of priors, likeliest first, ties by label."""
    pairs = F.transform(priors, lambda p, k: F.struct((-p).alias("p"), k.alias("k")))
    return F.transform(F.array_sort(pairs), lambda s: s["k"])


def k_star_column(priors: Column, epsilon: float) -> Column:
    """``k_star`` for a prior of each row."""
    e = math.exp(epsilon)
    sorted_p = F.transform(F.array_sort(F.transform(priors, lambda p: -p)), lambda p: -p)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("k"), F.lit(0.0).alias("best"), F.lit(1).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        cum = acc["cum"] + p
        w = F.lit(e) / (F.lit(e) + acc["k"]) * cum
        return F.struct(cum.alias("cum"), (acc["k"] + 1).alias("k"), F.greatest(w, acc["best"]).alias("best"), F.when(w > acc["best"], acc["k"] + 1).otherwise(acc["at"]).alias("at"))

    return F.aggregate(sorted_p, start, step, lambda acc: acc["at"])


def randomised(y: Column, order: Column, k: Column, epsilon: float, u: Column, v: Column, num_classes: int, outside: str = "top") -> Column:
    """A label's answer: itself with probability e^eps / (e^eps + k - 1), else another of the top k.

    ``u`` and ``v`` are uniform in [0, 1).  A label outside the top k is answered
    by any of the top k, or of all labels with ``outside="all"``.
    """
    keep = F.lit(math.exp(epsilon)) / (F.lit(math.exp(epsilon)) + k - 1)
    place = F.array_position(order, y)
    other = F.get(order, F.floor(v * (k - 1)).cast("int"))
    other = F.when(other == y, F.get(order, k - 1)).otherwise(other)
    span = k if outside == "top" else F.lit(num_classes)
    far = F.get(order, F.floor(v * span).cast("int")) if outside == "top" else F.floor(v * span).cast("int")
    return F.when(place <= k, F.when((u < keep) | (k <= 1), y).otherwise(F.coalesce(other, y))).otherwise(far)


def uniform(row_id: Column, seed: int) -> Column:
    """A fixed uniform number in [0, 1) of a row."""
    return F.pmod(F.xxhash64(row_id.cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def mismatched(assigned: DataFrame, keys: list[str], noised: str, true: str) -> DataFrame:
    """keys, mismatch: whether a node's most frequent noised label is not its most frequent true one; ties to the smaller."""

    def top(col: str, name: str) -> DataFrame:
        by = assigned.groupBy(*keys, col).agg(F.count("*").alias("n"))
        return by.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(col).alias("k")))["k"].alias(name))

    return top(noised, "_a").join(top(true, "_b"), keys).select(*keys, (F.col("_a") != F.col("_b")).alias("mismatch"))
