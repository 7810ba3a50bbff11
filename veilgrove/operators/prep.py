"""Relational preparation: encode, scale, sample, split, and deal columns to parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """value, code: rank among the sorted distinct values, from 0.  The window runs over distinct values only."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return values.select("value", (F.row_number().over(W.orderBy("value")) - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    codes = label_codes(df, col)
    return df.join(codes, df[col] == codes.value, "left").drop("value").withColumnRenamed("code", out)


def one_hot(df: DataFrame, col: str, drop_first: bool = True) -> DataFrame:
    """A 0/1 column for each value in sorted order; the first is left out if asked.  Null has zeros throughout."""
    values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values[int(drop_first) :]})


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant one becomes 0.  One aggregated row is joined to all others."""
    ends = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    scaled = {c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in cols}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*[f"_{e}_{c}" for e in ("lo", "hi") for c in cols])


def map_values(col: Column, mapping: dict, default: object = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, v)) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def decimal_comma(col: Column) -> Column:
    """A number written with a decimal comma."""
    return F.regexp_replace(col, ",", ".").cast("double")


def leading_int(col: Column, chars: int = 4) -> Column:
    return F.substring(col, 1, chars).try_cast("int")


def spread(row_id: Column, seed: int = 0, modulus: int = 1000) -> Column:
    """A fixed pseudo-random number of an integer id that any SQL engine computes alike."""
    return F.pmod(row_id * 7919 + seed, F.lit(modulus))


def hashed(row_id: Column, seed: int = 0) -> Column:
    return F.xxhash64(row_id, F.lit(seed))


def first_by(df: DataFrame, group: list[str], order: list[Column], share: Column) -> DataFrame:
    """Rows whose rank in their group is at most ``share`` of it: a pair of exact counts, not a Bernoulli draw."""
    w = W.partitionBy(*group)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).where(F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def balanced_sample(df: DataFrame, label: str, n: int, order: list[Column]) -> DataFrame:
    """n/2 rows of class 1 and the others of class 0, without replacement; raises if there are too few.

    The window holds the n rows of smallest order only: each class is cut by a
    top-n first, which Spark does by partial sorts.
    """
    want = {1: n // 2, 0: n - n // 2}
    have = {r[0]: r[1] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if any(have.get(k, 0) < v for k, v in want.items()):
        raise ValueError(f"asked for {want} rows of each class, there are {have}")
    return df.where(F.col(label) == 1).orderBy(*order).limit(want[1]).unionByName(df.where(F.col(label) == 0).orderBy(*order).limit(want[0]))


def uniform_sample(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stratified_split(df: DataFrame, label: str, order: list[Column], share: float = 0.2) -> DataFrame:
    """Adds is_val: in each class the first floor(share * n) rows in order."""
    w = W.partitionBy(label)
    return df.withColumn("is_val", F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) * share))


def allocate_columns(features: list[int], active_ratio: float, passive_ratio: float = -1, seed: int = 0, parties: int = 2) -> list[list[int]]:
    """Features in shuffled order: the active party gets max(1, int(ratio * m)), the passive ones share the rest or a cap of it."""
    m = len(features)
    order = sorted(features, key=lambda f: ((f * 7919 + seed) % 1000, f))
    active = max(1, int(active_ratio * m))
    rest = order[active:]
    if passive_ratio >= 0:
        rest = rest[: max(1, int(passive_ratio * m))]
    each, more = divmod(len(rest), max(1, parties - 1))
    out, at = [sorted(order[:active])], 0
    for k in range(parties - 1):
        size = each + (k < more)
        out.append(sorted(rest[at : at + size]))
        at += size
    return out


def allocate_by_importance(scores: dict[int, float], mode: int) -> tuple[list[int], list[int]]:
    """Mode 1: the less important half to the active party; 0: the more important; else both get the best half."""
    order = sorted(scores, key=lambda f: (scores[f], f))
    half = len(order) // 2
    if mode == 1:
        return sorted(order[:half]), sorted(order[half:])
    if mode == 0:
        return sorted(order[half:]), sorted(order[:half])
    return sorted(order[half:]), sorted(order[half:])


def even_split(workers: int, jobs: int) -> list[int]:
    """Jobs of each worker, the first ones taking the remainder."""
    each, more = divmod(jobs, workers)
    return [each + (k < more) for k in range(workers)]


def mutual_information(df: DataFrame, label: str, bins: dict[str, Column]) -> DataFrame:
    """feature, score: information in nats between a binned feature and the label, from one grouped count."""
    cells = df.select(label, F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), b.cast("long").alias("bin")) for k, b in bins.items()])).alias("c")).select(label, "c.*")
    joint = cells.groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    w = lambda *k: F.sum("n").over(W.partitionBy("feature", *k))
    part = F.col("n") / w() * F.log(F.col("n") * w() / (w("bin") * w(label)))
    return joint.withColumn("part", part).groupBy("feature").agg(F.sum("part").alias("score"))
