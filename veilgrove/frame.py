"""Vertical frames: one row set whose feature columns belong to different parties.

The canonical layout is wide: ``row_id``, ``y`` and one double column per global
feature.  ``Feature`` says which party owns a column.  ``cells`` gives the long
form for relational work.  NaN becomes null on the way in: the two compare
differently in SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Feature(NamedTuple):
    feature_id: int
    party_id: int
    name: str


class VerticalFrame(NamedTuple):
    data: DataFrame
    features: tuple[Feature, ...]
    num_classes: int
    row_id: str = "row_id"
    label: str = "y"

    def party(self, party_id: int) -> VerticalFrame:
        """What one party sees of the features."""
        return self._replace(features=tuple(f for f in self.features if f.party_id == party_id))

    def cells(self) -> DataFrame:
        """row_id, y, party_id, feature_id, x."""
        each = [F.struct(F.lit(f.party_id).alias("party_id"), F.lit(f.feature_id).alias("feature_id"), F.col(f.name).cast("double").alias("x")) for f in self.features]
        return self.data.select(self.row_id, self.label, F.explode(F.array(*each)).alias("c")).select(self.row_id, self.label, "c.*")


def clean(c: Column) -> Column:
    """A double with NaN as null."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def frame(df: DataFrame, row_id: Column, label: Column, parties: list[list[tuple[str, Column]]], num_classes: int) -> VerticalFrame:
    """Wide frame from expressions; features are numbered in party order, as parties hand them in."""
    features, cols = [], []
    for party, own in enumerate(parties):
        for name, c in own:
            features.append(Feature(len(features), party, name))
            cols.append(clean(c).alias(name))
    return VerticalFrame(df.select(row_id.alias("row_id"), label.cast("int").alias("y"), *cols), tuple(features), num_classes)


# -- adapters of the driver's tables -------------------------------------------------------------
def lineitem_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lineitem(spark: SparkSession, sf_dir: str, label: str = "returnflag") -> VerticalFrame:
    """Party 0: quantity, extended price; party 1: discount, tax.  Label: return flag (3 classes) or line status (2)."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) if label == "returnflag" else F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    named = [[("quantity", F.col("l_quantity")), ("extendedprice", F.col("l_extendedprice"))], [("discount", F.col("l_discount")), ("tax", F.col("l_tax"))]]
    return frame(df, lineitem_key(), y, named, 3 if label == "returnflag" else 2)


def embeddings(spark: SparkSession, sf_dir: str, dims: int = 64) -> VerticalFrame:
    """Dimensions of the vectors, the first half with party 0; 10 classes."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    col = lambda k: (f"e{k}", F.get(F.col("embedding"), F.lit(k)))
    return frame(df, F.col("vec_id"), F.col("label"), [[col(k) for k in range(dims // 2)], [col(k) for k in range(dims // 2, dims)]], 10)


def events(spark: SparkSession, sf_dir: str) -> VerticalFrame:
    """Party 0: value, missing on every seventh row; party 1: hour and user.  Label: event type."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.array_position(F.array(*[F.lit(k) for k in EVENT_TYPES]), F.col("event_type")) - 1
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return frame(df, F.col("event_id"), kinds, [[("value", value)], [("hour", F.hour("ts")), ("user_id", F.col("user_id"))]], len(EVENT_TYPES))


#: The event types of the driver's table, in order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
