"""Split search as relational steps: histogram, running sums, scores, argmax.

Running sums over an unbounded number of values are blocked: values are cut into
blocks at approximate quantiles, blocks are summed up, and a window runs inside
each block only.  No task ever sorts a whole feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrove.functions import scalar as S


def class_counts(y: Column, num_classes: int) -> list[Column]:
    return [F.sum(F.when(y == k, 1).otherwise(0)).cast("long").alias(f"c{k}") for k in range(num_classes)]


def histogram(cells: DataFrame, keys: list[str], sums: list[Column], value: str = "x") -> DataFrame:
    """One row for each key and distinct value; partial sums are made before the shuffle.  Missing values are left out."""
    return cells.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *sums)


def cumulative(hist: DataFrame, keys: list[str], value: str, cols: list[str], blocks: int = 64) -> DataFrame:
    """``hist`` and cum_<col>: the sum over all rows of the key with the same or a smaller value."""
    cuts = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    bounds = hist.groupBy(*keys).agg(F.percentile_approx(value, cuts, 2000).alias("_b"))
    placed = hist.join(bounds, keys).withColumn("_block", F.size(F.filter("_b", lambda b: b < F.col(value)))).drop("_b")
    sums = placed.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_p_{c}") for c in cols])
    within = W.partitionBy(*keys, "_block").orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    run = placed.select("*", *[F.sum(c).over(within).alias(f"_r_{c}") for c in cols]).join(base, [*keys, "_block"])
    return run.select(*hist.columns, *[(F.col(f"_p_{c}") + F.col(f"_r_{c}")).alias(f"cum_{c}") for c in cols])


def totals(hist: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return hist.groupBy(*keys).agg(*[F.sum(c).alias(f"tot_{c}") for c in cols])


def candidates(hist: DataFrame, keys: list[str], cols: list[str], value: str = "x", min_leaf: int = 1) -> DataFrame:
    """Thresholds (the values themselves; the test is x <= t) with both children of at least ``min_leaf`` rows."""
    got = cumulative(hist, keys, value, cols).join(totals(hist, keys, cols), keys)
    return got.where((F.col("cum_n") >= min_leaf) & (F.col("tot_n") - F.col("cum_n") >= min_leaf))


def gini_scores(cand: DataFrame, num_classes: int) -> DataFrame:
    left = [F.col(f"cum_c{k}") for k in range(num_classes)]
    whole = [F.col(f"tot_c{k}") for k in range(num_classes)]
    return cand.withColumn("score", F.round(S.split_score(left, whole), 9))


def gain_scores(cand: DataFrame, outputs: int, lam: float = 1.0, gamma: float = 0.0) -> DataFrame:
    pick = lambda p, s: [F.col(f"{p}_{s}{k}").cast("double") for k in range(outputs)]
    return cand.withColumn("score", F.round(S.gain(pick("cum", "g"), pick("cum", "h"), pick("tot", "g"), pick("tot", "h"), lam, gamma), 9))


def best(scored: DataFrame, by: list[str], order: list[str], keep: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """The row with the best score for each ``by``, and aggregates ``more``; of equal ones the first in ``order``.  An aggregation, not a sort."""
    first = F.min(F.struct((-F.col("score")).alias("_s"), *order, *[c for c in keep if c not in order]))
    more = more or {}
    got = scored.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*by).agg(first.alias("_b"), *[c.alias(k) for k, c in more.items()])
    return got.select(*by, *[F.col(f"_b.{c}").alias(c) for c in dict.fromkeys([*order, *keep])], (-F.col("_b._s")).alias("score"), *more)


def hazen(hist: DataFrame, keys: list[str], probs: int, value: str = "x") -> DataFrame:
    """keys, i, t: quantiles i/probs at places p*n - 1/2, between neighbours by linear interpolation (R's type 5).

    Ranks come from the running counts of distinct values: a value covers the
    places from its count before to its count through, so no row is ranked.
    """
    run = cumulative(hist.select(*keys, value, "n"), keys, value, ["n"])
    n = totals(hist, keys, ["n"])
    want = n.select(*keys, "tot_n", F.explode(F.sequence(F.lit(1), F.lit(probs))).alias("i"))
    place = F.col("i") / F.lit(float(probs)) * F.col("tot_n") - 0.5
    want = want.withColumn("_at", place).withColumn("_lo", F.greatest(F.floor("_at"), F.lit(0)).cast("long")).withColumn("_hi", F.least(F.ceil("_at"), F.col("tot_n") - 1).cast("long"))
    # Each value answers for the quantiles whose lower or upper neighbour it is.
    spans = run.join(n, keys).select(*keys, value, "tot_n", (F.col("cum_n") - F.col("n")).alias("_a"), (F.col("cum_n") - 1).alias("_z"))
    first = F.greatest(F.floor((F.col("_a") - 1.5) / F.col("tot_n") * probs).cast("int"), F.lit(1))
    last = F.least(F.ceil((F.col("_z") + 2.5) / F.col("tot_n") * probs).cast("int"), F.lit(probs))
    near = spans.where(first <= last).select(*keys, value, "_a", "_z", F.explode(F.sequence(first, last)).alias("i"))
    both = near.join(want, [*keys, "i"])
    side = lambda c: F.max(F.when(F.col(c).between(F.col("_a"), F.col("_z")), F.col(value)))
    got = both.groupBy(*keys, "i").agg(F.first("_at").alias("_at"), F.first("_lo").alias("_l"), side("_lo").alias("_x"), side("_hi").alias("_y"))
    return got.select(*keys, "i", (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.col("_l"))).alias("t"))


def bin_of(x: Column, thresholds: Column) -> Column:
    """Number of thresholds below x: x lies in the bin that ends at that threshold."""
    return F.size(F.filter(thresholds, lambda t: t < x))
