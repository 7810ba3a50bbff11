"""Quality rules: a threshold table compiled into one projection.

``THRESHOLDS`` names a numerator and a denominator among the measures of
``measures`` and the closed range their ratio must lie in.  ``verdict`` turns the
table into one Catalyst expression; there is no user function, no shuffle and no
state beyond the row, so a row of any length costs its own task only.

Defined cases: a null text is the empty one (no words, so it fails the base
rule); a ratio with a zero denominator is not judged; repeated rows are judged
alike; an empty table gives no rows; columns other than the id and the text are
not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import SPACE, text_or_empty

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on with as are be this by from or an at he have not you "
    "le la les de des du et un une que qui dans en est pour par sur au avec pas plus "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "el los las y del se por con una su para al lo como más o pero sus"
).split()


class Threshold(NamedTuple):
    name: str
    numerator: str
    denominator: str
    low: float
    high: float


THRESHOLDS = (
    Threshold("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Threshold("exclamations_per_word", "n_exclaims", "n_words", 0.0, 0.3),
    Threshold("stop_word_share", "n_stop_words", "n_words", 0.02, 1.0),
    Threshold("upper_case_share", "n_upper", "word_chars", 0.0, 0.4),
    Threshold("repeated_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
    Threshold("repeated_word_share", "n_repeat_words", "n_words", 0.0, 0.5),
)
MIN_WORDS = 50


def _without(col: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(col, pattern, ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_upper, n_exclaims.

    A repeated window is found by sorting a row's 3-word windows with their
    places and comparing neighbours, so its cost is n log n in the row's words.
    """
    src = text_or_empty(docs, id_col, text_col).select(F.col(id_col), F.col(text_col).alias("_t"))
    words = src.select(id_col, "_t", F.array_remove(F.split("_t", f"{SPACE}+"), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")).alias("_l"))
    stops = list(STOP_WORDS)
    counted = words.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _without("_t", r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        _without("_t", r"[^!]+").cast("long").alias("n_exclaims"),
        _without("_t", r"[^\p{Lu}]+").cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        F.expr("CASE WHEN size(_w) > 3 THEN sort_array(transform(sequence(0, size(_w) - 3), i -> struct(concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]) AS s, i AS i))) ELSE array() END").alias("_s"),
    )
    again = F.expr("transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].s = x.s) OR (k + 1 < size(_s) AND _s[k + 1].s = x.s)), x -> x.i)")
    kept = [c for c in counted.columns if c != "_s"]
    return counted.select(*kept, again.alias("_d")).select(*kept, F.expr("CAST(size(array_distinct(flatten(transform(_d, i -> array(i, i + 1, i + 2))))) AS BIGINT)").alias("n_repeat_words"))


def verdict(table: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """True where every ratio of the table is in its range."""
    out = F.lit(True)
    for t in table:
        ratio = F.try_divide(F.col(t.numerator), F.col(t.denominator))
        out = out & F.coalesce(ratio.between(t.low, t.high), F.lit(True))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The measures, ``base_failed`` and ``kept`` (false where the base rule fails, else the table's verdict)."""
    m = measures(docs, id_col, text_col)
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(table))


#: The same in SQL, with windows as rows; the columns of op8_quality_rules.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
        list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM s WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims,
        length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({t.numerator}::DOUBLE / nullif({t.denominator}, 0) BETWEEN {t.low} AND {t.high}, true)" for t in THRESHOLDS)} AS kept
FROM b
"""
