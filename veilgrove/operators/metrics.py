"""Metrics of predictions, of clusterings, and of what a run sends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrove.operators.split import cumulative


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """by, auc: chance that a positive row scores above a negative one, ties counting half.

    Rows are first counted by distinct score; running counts over them are
    blocked, so no window holds all rows.  Null without both classes.
    """
    by = by or []
    src = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    hist = src.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("q"))
    run = cumulative(hist, keys, score, ["q"])
    below = F.col("cum_q") - F.col("q")
    got = run.groupBy(*keys).agg(F.sum(F.col("p") * (2 * below + F.col("q"))).alias("_w"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return got.select(*by, F.try_divide(F.col("_w"), 2 * F.col("_p") * F.col("_q")).alias("auc"))


def ovr_auc(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """Mean over classes with rows on both sides of their one-against-rest AUC."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("s")) for k, c in enumerate(scores)])).alias("c")
    long = df.select(label, each).select(label, "c.k", "c.s")
    return auc(long, "s", F.col(label) == F.col("k"), ["k"]).agg(F.avg("auc").alias("auc"))


def trapezoid(df: DataFrame, x: str, y: str, order: str) -> DataFrame:
    w = W.orderBy(order)
    return df.select(((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a")).agg(F.sum("a").alias("area"))


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    return df.groupBy(label, cluster).agg(F.count("*").alias("n"))


def cluster_scores(table: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: homogeneity, completeness, v_measure, purity, inverse_purity, f_measure, fowlkes_mallows.

    From the contingency table only, so its cost is classes times clusters.
    """
    rows, cols = table.groupBy(label).agg(F.sum("n").alias("a")), table.groupBy(cluster).agg(F.sum("n").alias("b"))
    both = table.join(rows, label).join(cols, cluster)
    n = table.agg(F.sum("n").alias("t"))
    t = both.crossJoin(F.broadcast(n))
    given_cluster = F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("b")))
    given_label = F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("a")))
    f = 2 * F.col("n") / (F.col("a") + F.col("b"))
    one = t.agg(given_cluster.alias("hck"), given_label.alias("hkc"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("t").alias("t"))
    hc = rows.crossJoin(F.broadcast(n)).agg(F.sum(-F.col("a") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("hc"), F.sum(F.col("a") * F.col("a")).alias("aa"))
    hk = cols.crossJoin(F.broadcast(n)).agg(F.sum(-F.col("b") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("hk"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    pure = t.groupBy(cluster).agg(F.max("n").alias("m"), F.max("t").alias("t")).agg(F.sum(F.col("m") / F.col("t")).alias("purity"))
    per_label = t.groupBy(label).agg(F.max("n").alias("m"), F.max(f).alias("f"), F.max("a").alias("a"), F.max("t").alias("t"))
    inverse = per_label.agg(F.sum(F.col("m") / F.col("t")).alias("inverse_purity"), F.sum(F.col("f") * F.col("a") / F.col("t")).alias("f_measure"))
    all_of = reduce(lambda x, y: x.crossJoin(y), [one, hc, hk, pure, inverse])
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(1 - F.try_divide(F.col(a), F.col(b)))
    got = all_of.withColumns({"homogeneity": share("hck", "hc"), "completeness": share("hkc", "hk")})
    v = F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0))
    pairs = F.try_divide((F.col("nn") - F.col("t")).cast("double"), F.sqrt((F.col("aa") - F.col("t")).cast("double")) * F.sqrt((F.col("bb") - F.col("t")).cast("double")))
    return got.select("homogeneity", "completeness", v.alias("v_measure"), "purity", "inverse_purity", "f_measure", F.coalesce(pairs, F.lit(0.0)).alias("fowlkes_mallows"))


def purity(df: DataFrame, label: str, groups: list[str]) -> DataFrame:
    """Rows in their group's most frequent class, over all rows."""
    by = df.groupBy(*groups, label).agg(F.count("*").alias("n")).groupBy(*groups).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return by.agg((F.sum("m") / F.sum("n")).alias("purity"))


def ciphertexts(candidates: int, rows: int, num_classes: int, rounds: int, secure_rounds: int, boosting: bool, with_ratios: bool) -> int:
    """Ciphertexts that an encrypted run sends, from its counts: per passive candidate and per row and round."""
    k = num_classes
    if not boosting:
        return candidates * k + rows * k
    per = 2 * k + (k if with_ratios else 0)
    return candidates * per + rows * 2 * (rounds - secure_rounds) * (k if k > 2 else 1)


def mean_std(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean, population and sample deviation of each column, to four digits."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}_{s}") for c in cols for f, s in ((lambda c: F.round(F.avg(c), 4), "mean"), (lambda c: F.round(F.stddev_pop(c), 4), "pop"), (lambda c: F.round(F.stddev_samp(c), 4), "samp"))])
