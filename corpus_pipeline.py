"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes every stage's result as a table
in the shared checkpoint folder and reads it again as the next one's input, so a
lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove.llm import bpe, decontaminate, line_dedup, quality, simhash
from veilgrove.llm.common import cut, free, free_prefix, stored, table

#: Contaminated ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled ones among ``docs``.

    A null text is the empty one, and null sources and languages are a site of
    their own; texts of any length are read whole; rows are judged one by one, so
    equal ones go or stay together; columns of ``docs`` stay as they are, whatever
    their names; an empty table gives no rows.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    prefix = free_prefix(docs)
    scored = quality.classify(docs, model, F.col("source"), F.col("lang"), prefix=prefix)
    return scored.where(F.col(f"{prefix}kept")).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line resembles; n_chars is that of the new text.

    Null texts become empty; documents with a null id come first, and such with
    one id but different texts are told apart; equal rows lose the same lines;
    lines of any length count; other columns stay; an empty table gives no rows.
    """
    got = line_dedup.dedup(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 4/5 or more).

    The one with the smallest id stays, a null id being the last choice; rows are
    told apart by all their columns, so null and repeated ids lose nothing that is
    no copy, and of equal rows one stays; all texts without a word are copies;
    texts of any length count in whole; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Rows are told apart by all their columns, so a row goes for its own text
    only, whatever its id; null and empty texts hold nothing; texts of any length
    are read whole; an empty table gives no rows, an empty benchmark takes none.
    """
    tagged, a, b = simhash.row_keys(docs)
    pair = free(docs, "_pair")
    rows = tagged.select(F.struct(a, b).alias(pair), "text")
    held = cut(decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=pair).select(f"{pair}.{a}", f"{pair}.{b}").distinct())
    if held.count() <= BROADCAST_IDS:
        held = F.broadcast(held)
    return tagged.join(held, [a, b], "left_anti").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, per row.

    A null text is the empty one, without tokens; texts of any length are encoded
    whole; equal rows give equal rows; other columns are not read; an empty table
    gives no rows.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]

#: No stage but the decontamination's filter can be put into SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
