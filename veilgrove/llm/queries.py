"""The driver's queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove.llm import bpe, decontaminate, html_text, line_dedup, pii, quality, rules, secret_scan, simhash, token_counts
from veilgrove.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_query(op8_quality_rules, rules.SQL)


@_query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.secrets(documents(spark, sf_dir))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.count(documents(spark, sf_dir), rule="majority")
    whole = [F.col(c).cast("long").alias(c) for c in ("title_tokens", "body_tokens", "blank_tokens")]
    return got.select("doc_id", "n_tokens", "n_sections", "n_crossing", *whole, F.array_join(F.col("section_tokens").cast("array<long>").cast("array<string>"), ",").alias("section_tokens"))


@_query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.classify(docs.select("doc_id", "text", "source", "lang"), model, F.col("source"), F.col("lang"))
    return got.select("doc_id", *quality.RESULTS)


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.personal_data(documents(spark, sf_dir))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_more")


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
