"""Column expressions of the learners: all built-in, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this margin the sigmoid is one or zero to fifteen digits.
CLIP = 34.538776394910684
EPS = 1e-15


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def sigmoid(x: Column) -> Column:
    x = F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP))
    return 1 / (1 + F.exp(-x))


def softmax(logits: list[Column]) -> list[Column]:
    """Shifted by the largest, so nothing overflows."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = [F.exp(x - top) for x in logits]
    return [x / total(e) for x in e]


def gini(counts: list[Column]) -> Column:
    """1 - sum of squared class shares; null for an empty node."""
    n = total(counts)
    return 1 - total([F.try_divide(c, n) * F.try_divide(c, n) for c in counts])


def entropy(n: Column, positive: Column) -> Column:
    """Binary entropy in bits; 0 for a pure or empty node."""
    p = F.coalesce(F.try_divide(positive, n), F.lit(0.0))
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def split_score(left: list[Column], whole: list[Column]) -> Column:
    """Impurity of a node less the weighted impurity of its children."""
    right = [w - c for c, w in zip(left, whole, strict=True)]
    nl, n = total(left), total(whole)
    share = F.try_divide(nl, n)
    zero = F.lit(0.0)
    return gini(whole) - share * F.coalesce(gini(left), zero) - (1 - share) * F.coalesce(gini(right), zero)


def gain(gl: list[Column], hl: list[Column], g: list[Column], h: list[Column], lam: float = 1.0, gamma: float = 0.0) -> Column:
    """Second-order gain of a split, added up over classes."""
    term = lambda a, b: F.try_divide(a * a, b + lam)
    each = [0.5 * (term(a, b) + term(ga - a, ha - b) - term(ga, ha)) - gamma for a, b, ga, ha in zip(gl, hl, g, h, strict=True)]
    return total(each)


def leaf_weight(g: Column, h: Column, lam: float = 1.0) -> Column:
    return F.try_divide(-g, h + lam)


def divergence(counts: list[Column], prior: list[Column]) -> Column:
    """KL divergence of class shares from a prior; an empty side says nothing and diverges by 0."""
    n = total(counts)
    p = [F.coalesce(F.try_divide(c, n), F.lit(0.0)) for c in counts]
    return F.when(n > 0, total([a * F.log(EPS + F.try_divide(a, b)) for a, b in zip(p, prior, strict=True)])).otherwise(0.0)


def bce_gradient(y: Column, p: Column) -> Column:
    return p - y


def bce_hessian(p: Column) -> Column:
    return p * (1 - p)


def bce_loss(y: Column, p: Column) -> Column:
    """Standard log-loss of one row, from its probability."""
    clip = lambda q: F.greatest(q, F.lit(EPS))
    return -(y * F.log(clip(p)) + (1 - y) * F.log(clip(1 - p)))


def bce_loss_of_probability(y: Column, p: Column) -> Column:
    """The variant that squashes twice: log(1 + exp(-p)) or log(1 + exp(p))."""
    return F.when(y == 1, F.log1p(F.exp(-p))).otherwise(F.log1p(F.exp(p)))


def ce_gradients(y: Column, probs: list[Column]) -> list[Column]:
    return [p - F.when(y == k, 1.0).otherwise(0.0) for k, p in enumerate(probs)]


def ce_hessians(probs: list[Column]) -> list[Column]:
    return [p * (1 - p) for p in probs]


def ce_loss(y: Column, probs: list[Column]) -> Column:
    return -F.log(F.greatest(F.element_at(F.array(*probs), y + 1), F.lit(EPS)))


def pair_key(i: Column, j: Column) -> Column:
    """One number for an ordered pair of non-negative numbers, without collisions (Szudzik)."""
    return F.when(i >= j, i * i + i + j).otherwise(i + j * j)
