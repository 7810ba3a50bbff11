"""Clustering on MLlib: k-means, x-means, the k with the best drop of error, and principal axes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_means(df: DataFrame, k: int, features: str = "features", seed: int = 0) -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    return model.transform(df)


def _bic(n: int, dims: int, errors: list[float], sizes: list[int]) -> float:
    """Bayesian information criterion of spherical clusters; larger is better."""
    k = len(sizes)
    variance = max(sum(errors) / max(1, n - k) / dims, 1e-12)
    fit = sum(s * math.log(max(s, 1) / n) for s in sizes) - n * dims / 2 * math.log(2 * math.pi * variance) - (n - k) * dims / 2
    return fit - (k * (dims + 1)) / 2 * math.log(n)


class Moments(NamedTuple):
    """Size, mean and scatter (the sum of outer products about the mean) of a cluster."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def error(self) -> float:
        return float(np.trace(self.scatter))

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.scatter + other.scatter + np.outer(d, d) * self.n * other.n / n)


def moments(df: DataFrame, features: str = "features") -> dict[int, Moments]:
    """Moments of each cluster; a task sends one row for each cluster and dimension, whose sums reach the driver."""
    one = df.select("cluster", vector_to_array(features).alias("v"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for c, rows in b.groupby("cluster")["v"]:
                x = np.vstack(rows.to_numpy())
                # Sums of outer products of (1, x): the count, the sums and the products in one matrix.
                x = np.hstack([np.ones((len(x), 1)), x])
                sums[c] = sums.get(c, 0) + x.T @ x
        yield pd.DataFrame([(int(c), i, row.tolist()) for c, m in sums.items() for i, row in enumerate(m)], columns=["cluster", "i", "row"])

    rows = one.mapInPandas(part, "cluster int, i int, row array<double>").select("cluster", "i", F.posexplode("row").alias("j", "v"))
    out: dict[int, list] = {}
    for r in rows.groupBy("cluster", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.cluster, []).append((r.i, r.j, r.v))
    got = {}
    for c, cells in out.items():
        m = np.zeros((1 + max(i for i, _, _ in cells),) * 2)
        for i, j, v in cells:
            m[i, j] = v
        mean = m[0, 1:] / m[0, 0]
        got[c] = Moments(int(round(m[0, 0])), mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
    return got


def log_likelihood(m: Moments) -> float | None:
    """Of a cluster's rows under the normal law of their own mean and covariance (with n - 1); none if that is singular."""
    d = len(m.mean)
    sign, logdet = np.linalg.slogdet(m.scatter / max(1, m.n - 1))
    if m.n <= d or sign <= 0 or not math.isfinite(logdet):
        return None
    return -0.5 * (m.n * (d * math.log(2 * math.pi) + logdet) + (m.n - 1) * d)


def splits_by_normal_law(one: Moments, a: Moments, b: Moments) -> bool:
    """Whether two normal laws describe a cluster's halves better than one describes it whole.

    The halves' likelihood is scaled for their overlap: by 1/2 over the normal
    distribution function of their centres' distance over the root of the sum of
    their determinants.  Where a law is singular, as of fewer rows than
    dimensions, no likelihood is defined and the cluster stays.
    """
    laws = [log_likelihood(m) for m in (one, a, b)]
    if any(x is None for x in laws):
        return False
    whole, la, lb = laws
    d = len(one.mean)
    df = d * (d + 3) / 2
    dets = [math.exp(min(700.0, np.linalg.slogdet(m.scatter / max(1, m.n - 1))[1])) for m in (a, b)]
    spread = math.sqrt(sum(dets))
    beta = float(np.linalg.norm(a.mean - b.mean)) / spread if spread else math.inf
    alpha = 0.5 / (0.5 * (1 + math.erf(beta / math.sqrt(2))))
    two = -2 * (one.n * math.log(alpha) + la + lb) + 2 * df * math.log(one.n)
    return two < -2 * whole + df * math.log(one.n)


def splits_by_spheres(one: Moments, a: Moments, b: Moments) -> bool:
    """Whether two spheres of one common variance describe a cluster better than one."""
    d = len(one.mean)
    return _bic(one.n, d, [a.error, b.error], [a.n, b.n]) > _bic(one.n, d, [one.error], [one.n])


def x_means(df: DataFrame, cut: Callable[[DataFrame], DataFrame], features: str = "features", limit: int | None = None, seed: int = 0, begin: int = 1, splits: Callable[[Moments, Moments, Moments], bool] = splits_by_spheres) -> DataFrame:
    """Clusters, ``begin`` of them at first, are split in two as long as ``splits`` says so, up to ``limit`` if there is one; ones of three rows or fewer stay.

    All rows are in one frame with the number of their cluster; a round tries all
    open clusters, and what it decides is a small map that is applied to the rows.
    """
    src = k_means(df, begin, features, seed) if begin > 1 else df.withColumn("cluster", F.lit(0))
    src = cut(src)
    known = moments(src, features)
    open_, closed, label = sorted(known), [], max(known, default=0) + 1
    while open_:
        to: dict[tuple[int, int], int] = {}
        nxt, halves = [], []
        for c in open_:
            if known[c].n <= 3 or (limit is not None and len(open_) + len(closed) + len(halves) >= limit):
                closed.append(c)
                continue
            part = src.where(F.col("cluster") == c).drop("cluster")
            model = KMeans(k=2, seed=seed, featuresCol=features, predictionCol="cluster").fit(part)
            two = moments(model.transform(part), features)
            if len(two) == 2 and splits(known[c], two[0], two[1]):
                halves.append((c, label, model))
                known[c], known[label] = two[0], two[1]
                nxt += [c, label]
                label += 1
            else:
                closed.append(c)
        for c, new, model in halves:
            centres = [F.array(*[F.lit(float(v)) for v in x]) for x in model.clusterCenters()]
            far = lambda x: F.aggregate(F.zip_with(vector_to_array(features), x, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
            src = src.withColumn("cluster", F.when((F.col("cluster") == c) & (far(centres[1]) < far(centres[0])), new).otherwise(F.col("cluster")))
        if halves:
            src = cut(src)
        open_ = nxt
    return src


def sse_means(df: DataFrame, most: int = 20, features: str = "features", seed: int = 42) -> DataFrame:
    """k-means with the k below ``most`` whose root of error over expected error is largest.

    The expected error of k clusters is (most - k) / k times the least of
    j + error(j + 1) / (most - j + 1) over j below k.
    """
    src = df.persist()
    try:
        models, errors, best = {}, [], (-math.inf, 1)
        for k in range(1, most):
            if k == 1:
                errors.append(next(iter(moments(src.withColumn("cluster", F.lit(0)), features).values())).error)
            else:
                models[k] = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(src)
                errors.append(models[k].summary.trainingCost)
            expected = (most - k) / k * min(j + errors[j] / (most - j + 1) for j in range(k))
            ratio = math.sqrt(errors[-1] / expected) if expected > 0 else 0.0
            if ratio > best[0]:
                best = (ratio, k)
        return df.withColumn("cluster", F.lit(0)) if best[1] == 1 else models[best[1]].transform(df)
    finally:
        src.unpersist()


def truncated_svd(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """Adds sv: the row's coordinates on the first ``k`` right singular vectors, each turned so that its largest entry is positive; rows are not centred."""
    whole = next(iter(moments(df.withColumn("cluster", F.lit(0)), features).values()))
    gram = whole.scatter + whole.n * np.outer(whole.mean, whole.mean)
    value, vector = np.linalg.eigh(gram)
    axes = vector[:, np.argsort(-value)[:k]].T
    axes = [x * np.sign(x[np.argmax(np.abs(x))]) for x in axes]
    dot = lambda x: F.aggregate(F.zip_with(vector_to_array(features), F.array(*[F.lit(float(v)) for v in x]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("sv", F.array(*map(dot, axes)))


def principal(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    return model.transform(df).withColumn("pc", vector_to_array("_pc")).drop("_pc")
