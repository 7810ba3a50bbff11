"""Readers of the plain-text tables that experiments start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def headerless(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Values only; any separator, so also blanks and semicolons."""
    return spark.read.csv(path, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def with_header(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True)


def _values(lines: DataFrame, schema: str, sep: str) -> DataFrame:
    return lines.select(F.from_csv("value", F.lit(schema), {"sep": sep}).alias("r")).select("r.*")


def after_lines(spark: SparkSession, path: str, schema: str, skip: int, sep: str = ",") -> DataFrame:
    """The rows of one file after its first ``skip`` lines, however often the text of these comes again.

    A line's place is that of its split in the file and its number there, so a
    file of many splits is read by many tasks.
    """
    lines = spark.read.text(path)
    if skip:
        if len(lines.inputFiles()) != 1:
            raise ValueError("lines are skipped in one file")
        placed = lines.select("value", F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k")).alias("_place"))
        head = placed.orderBy("_place").limit(skip).agg(F.max("_place").alias("p")).first().p
        lines = placed.where((F.col("_place.at") > head.at) | ((F.col("_place.at") == head.at) & (F.col("_place.k") > head.k))).select("value") if head else lines
    return _values(lines.where(F.trim("value") != ""), schema, sep)


def arff(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The body of an attribute-relation file: every line that is neither a declaration nor a comment."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(@|%|$)"))
    return _values(lines, schema, ",")
