"""Benchmark decontamination by template canonicalisation.

Numbers, names inside sentences, and units after numbers become typed
placeholders; case and punctuation go.  Where a text has names it is read in up
to three ways: so; with names as plain words, which finds a copy in any case;
and with capitalised words typed wherever the same word is a name elsewhere in
the text, which finds names that open a sentence.  Windows of ``WINDOW``
canonical tokens of all readings are hashed on both sides and joined.  Matches
on one diagonal (the same distance between the place in the document and that in
the item) are one occurrence of the item.  Every value of the item's slots should
be replaced by one value throughout: if one is not although it stands in the
same context (a number before the same word, a unit after the same number, a
name), the occurrence does not count; if only its contexts differ, as of equal
numbers of two things, the windows that hold it do not.  So a question with other
numbers is caught, and a text that only shares the frame, with values at odds, is
not.  A document holds an item if the item's windows that count are at least
``COVERAGE`` of all of them.

The benchmark's windows are broadcast only if they are no more than
``BROADCAST_WINDOWS``; beyond, both sides are shuffled by hash.  Only built-in
functions are used.

Defined cases: a null text is the empty one, which holds nothing and is in no
document; items shorter than a window, however short, are looked for as one window
of their own length, with the very values that they have, since so short a frame
tells nothing; repeated rows of a document are one document; rows without an id
are found as the id null; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import cut, text_or_empty

WINDOW, COVERAGE = 8, 0.5
BROADCAST_WINDOWS = 500_000

#: Private-use characters that stand for a number, a name and a unit.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units that count as such after a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mile miles foot feet ft inch inches hour hours minute minutes second seconds day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent liter liters litre litres ml degree degrees meter meters metre metres mph kmh"
).split()
_UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}\p{N}])"
NUMBER_PATTERN = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[0-9]++(?:[.,:/][0-9]++)*+(?=(?i:{_UNIT})|(?![\p{{L}}\p{{M}}\p{{N}}]))"
NAME_PATTERN = r"(?<=[\p{Ll},;:] )\p{Lu}\p{Ll}++(?![\p{L}\p{M}\p{N}])"
CAPITAL = r"^\p{Lu}\p{Ll}+$"
WORD_PATTERN = rf"{NUMBER_PATTERN}|[\p{{L}}\p{{M}}\p{{N}}]++"


def canonical(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_tok`` (canonical tokens) and ``_val`` (the words themselves where there is a placeholder, else null)."""
    marks = NUMBER + NAME + UNIT
    t = F.col(text_col)
    odd = F.contains(t, F.lit(NUMBER)) | F.contains(t, F.lit(NAME)) | F.contains(t, F.lit(UNIT))
    d = df.withColumn("_t", F.when(odd, F.translate(t, marks, "   ")).otherwise(t))
    d = d.withColumn("_n", F.col("_t").rlike("[0-9]"))
    d = d.withColumn("_a", F.regexp_replace("_t", NAME_PATTERN, NAME))
    d = d.withColumn("_a", F.lower(F.when(F.col("_n"), F.regexp_replace("_a", NUMBER_PATTERN, f" {NUMBER} ")).otherwise(F.col("_a"))))
    d = d.withColumn("_a", F.when(F.col("_n"), F.regexp_replace("_a", rf"{NUMBER}\s+{_UNIT}", f"{NUMBER} {UNIT}")).otherwise(F.col("_a")))
    d = d.withColumn("_tok", F.array_remove(F.split("_a", rf"[^\p{{L}}\p{{M}}\p{{N}}{marks}]+"), ""))
    slots = F.contains(F.col("_a"), F.lit(NUMBER)) | F.contains(F.col("_a"), F.lit(NAME))
    d = d.withColumn("_val", F.when(slots, F.regexp_extract_all("_t", F.lit(WORD_PATTERN), 0)))
    return d.drop("_t", "_n", "_a")


def readings(df: DataFrame) -> DataFrame:
    """Adds ``_low`` (the canonical tokens with names as the lower-case words they are) and ``_typed`` (with names also where a
    capitalised word, such as a sentence's first, is a name elsewhere in the text); null where there is no such difference.
    """
    both = F.when(F.col("_val").isNotNull() & (F.size("_val") == F.size("_tok")) & F.array_contains("_tok", NAME), F.arrays_zip("_tok", "_val"))
    d = df.withColumn("_both", both)
    names = F.transform(F.filter("_both", lambda x: x["_tok"] == NAME), lambda x: F.lower(x["_val"]))
    capitals = F.transform(F.filter("_both", lambda x: ~x["_tok"].isin(NUMBER, NAME, UNIT) & x["_val"].rlike(CAPITAL)), lambda x: x["_tok"])
    d = d.withColumn("_more", F.array_intersect(names, capitals))
    d = d.withColumn("_low", F.transform("_both", lambda x: F.when(x["_tok"] == NAME, F.lower(x["_val"])).otherwise(x["_tok"])))
    typed = F.transform("_both", lambda x: F.when(F.array_contains(F.col("_more"), x["_tok"]) & x["_val"].rlike(CAPITAL), NAME).otherwise(x["_tok"]))
    return d.withColumn("_typed", F.when(F.size("_more") > 0, typed)).drop("_both", "_more")


def _slots(tok: str, at: Column, size: int, context: bool) -> Column:
    """The values in the placeholders of the window from ``at`` (0 first), each with its type; null where the text has none.

    With ``context``, each is a struct with the word that tells equal values
    apart: the one after a number, the one before a unit, none for a name.
    """

    def marked(k: int) -> Column:
        own = F.col(tok)[at + k]
        value = F.concat(own, F.lower(F.col("_val")[at + k]))
        if context:
            near = F.when(own == NUMBER, F.lower(F.get("_val", at + k + 1))).when(own == UNIT, F.lower(F.get("_val", at + k - 1)))
            value = F.struct(value.alias("value"), F.coalesce(near, F.lit("")).alias("context"))
        return F.when(own.isin(NUMBER, NAME, UNIT), value)

    return F.when(F.col("_val").isNotNull() & (F.size("_val") == F.size("_tok")), F.filter(F.array(*map(marked, range(size))), lambda x: x.isNotNull()))


def windows(df: DataFrame, keep: list[str], size: int, context: bool = False) -> DataFrame:
    """``keep``, place, hash, slots of every window of ``size`` tokens, in each reading that differs there.

    Elements are taken one by one, since slice() copies the whole array each
    time; and the arrays are exploded as outer ones, since the optimiser infers
    a filter from others that would compute all windows a second time.
    """
    hashes = {t: f"{t}_h" for t in ("_tok", "_low", "_typed")}
    hashed = df.select(*keep, *hashes, "_val", *[F.transform(t, lambda x: F.xxhash64(x)).alias(h) for t, h in hashes.items()])
    at = F.sequence(F.lit(0), F.size("_tok_h") - size)

    def window(t: str, i: Column) -> Column:
        return F.struct(i.alias("place"), _hash(t, i).alias("hash"), _slots(t, i, size, context).alias("slots"))

    def _hash(t: str, i: Column) -> Column:
        return F.xxhash64(*[F.col(hashes[t])[i + k] for k in range(size)])

    def others(t: str) -> Column:
        return F.transform(F.filter(at, lambda i: _hash(t, i) != _hash("_tok", i)), lambda i: window(t, i))

    one = F.transform(at, lambda i: window("_tok", i))
    each = F.when(F.col("_low").isNull(), one).when(F.col("_typed").isNull(), F.concat(one, others("_low"))).otherwise(F.concat(one, others("_low"), others("_typed")))
    each = F.when(F.size("_tok_h") >= size, each)
    return hashed.select(*keep, each.alias("_w")).select(*keep, F.explode_outer("_w").alias("_w")).select(*keep, "_w.place", "_w.hash", "_w.slots")


def _benchmark(bench: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """Windows of all items, and the sizes of windows that there are."""
    tok = canonical(text_or_empty(bench, item_col, text_col).select(F.col(item_col).alias("item"), F.col(text_col).alias("_text")), "_text").drop("_text")
    tok = readings(tok).withColumn("size", F.least(F.size("_tok"), F.lit(WINDOW))).where(F.col("size") >= 1)
    tok = tok.withColumn("n_windows", F.size("_tok") - F.col("size") + 1)
    parts = [windows(tok.where(F.col("size") == k), ["item", "size", "n_windows"], k, True) for k in range(1, WINDOW + 1)]
    all_of = parts[0]
    for p in parts[1:]:
        all_of = all_of.unionByName(p)
    got = cut(all_of.select("item", "size", "n_windows", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots")))
    return got, sorted(r.n for r in got.select(F.col("size").alias("n")).distinct().collect())


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """id, item, n_matched, n_windows, same_values: the documents that hold an item, and which."""
    known, sizes = _benchmark(bench, item_col, item_text_col)
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    tok = readings(canonical(text_or_empty(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text").drop("_text"))
    found = None
    for size in sizes or [WINDOW]:
        own = windows(tok, ["id"], size)
        hit = own.join(known.where(F.col("size") == size), "hash")
        hit = hit.select("id", "item", "size", "n_windows", "item_place", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_slots", "slots")
        found = hit if found is None else found.unionByName(hit)
    pairs = F.when(F.size("item_slots") > 0, F.arrays_zip("item_slots", "slots"))
    once = found.groupBy("id", "item", "size", "n_windows", "diagonal").agg(F.collect_set(F.struct(F.col("item_place").alias("place"), pairs.alias("pairs"))).alias("found"))
    once = once.withColumn("pairs", F.array_distinct(F.flatten(F.filter(F.transform("found", lambda w: w["pairs"]), lambda p: p.isNotNull()))))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"]))) == F.size("pairs")
    once = once.where(consistent).withColumn("values", F.array_distinct(F.transform("pairs", lambda p: F.struct(p["item_slots"]["value"].alias("item"), p["slots"].alias("doc")))))
    items = F.array_distinct(F.transform("values", lambda v: v["item"]))
    odd = F.when(F.size(items) < F.size("values"), F.filter(items, lambda x: F.size(F.filter("values", lambda v: v["item"] == x)) > 1))
    once = once.withColumn("odd", odd)
    left = F.filter("found", lambda w: ~F.coalesce(F.exists(w["pairs"], lambda p: F.array_contains(F.col("odd"), p["item_slots"]["value"])), F.lit(False)))
    once = once.withColumn("found", F.when(F.col("odd").isNull(), F.col("found")).otherwise(left)).where(F.size("found") > 0)
    same = F.forall("found", lambda w: F.coalesce(F.forall(w["pairs"], lambda p: p["item_slots"]["value"] == p["slots"]), F.lit(True)))
    places = F.array_distinct(F.transform("found", lambda w: w["place"]))
    held = once.select("id", "item", "size", "n_windows", places.alias("places"), same.alias("same")).where((F.col("size") == WINDOW) | F.col("same")).groupBy("id", "item", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"), F.bool_and("same").alias("same_values"))
    return held.where(F.col("n_matched") >= coverage * F.col("n_windows")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_windows", "same_values")
