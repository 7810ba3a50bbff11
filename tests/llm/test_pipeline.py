import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint
from veilgrove.llm import quality

WORDS = "the of and to river stone bird wind moon tree road song night day rain snow with for that house field water light green".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS) + str(k) for _ in range(20))) for k in range(5)]
    docs, labels = [], []
    for i in range(260):
        w = [rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(60, 140))]
        t = "\n".join(" ".join(w[k : k + 20]) for k in range(0, len(w), 20))
        kind = rng.random()
        bad = kind < 0.15
        if bad:
            t = " ".join(x + "###" for x in t.split())
        elif kind < 0.25:
            t += "\n" + rng.choice(items)[1]
        elif kind < 0.4 and docs:
            t = rng.choice(docs)[1] or ""
        docs.append((i, t, rng.choice(["en", None]), f"s{i % 3}", len(t)))
        if not 0.25 <= kind < 0.4:
            labels.append((i, int(not bad), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), docs[5], (None, docs[7][1], "en", "s1", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, items


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    root, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{name}"
        stage(spark, docs, root).write.parquet(out)
        after = spark.read.parquet(out)
        if k < 4:
            assert after.columns == columns
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality_classifier":
            model = quality.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
            want = {r.doc_id for r in quality.classify(docs, model, F.col("source"), F.col("lang")).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
            assert not any("###" in (r.text or "") for r in after.collect())
            assert sum("###" not in (t or "") and bool(t) for _, t in before) == after.where("text <> ''").count()
        elif name == "line_dedup":
            gone = brute_lines(before)
            want = sorted((str(i), "\n".join(x for m, x in enumerate((t or "").split("\n")) if (i, m) not in gone)) for i, t in before)
            assert sorted((str(r.doc_id), r.text) for r in after.collect()) == want
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "near_duplicates":
            known = [(i, t) for i, t in before if i is not None]
            groups = brute_components([i for i, _ in known], [brute_fingerprint(t) for _, t in known])
            assert sorted(r.doc_id for r in after.where("doc_id IS NOT NULL").collect()) == sorted(set(groups))
        elif name == "benchmark_decontamination":
            held = {i for i, t in before if any(x in (t or "") for _, x in items)}
            assert {r.doc_id for r in after.collect()} == {i for i, _ in before} - held and held
        else:
            assert sorted(str(r.doc_id) for r in after.collect()) == sorted(str(i) for i, _ in before)
        docs = after


def test_run(spark, tables):
    root, _ = tables
    got = corpus_pipeline.run(spark, root)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 20 < got.count() < 260


def test_odd_ids_repeats_and_clashing_names_lose_no_clean_document(spark, tables):
    """Null and repeated ids over different texts, equal rows, and columns named like those that stages make."""
    root, items = tables
    rng = random.Random(21)
    clean = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(90)) for _ in range(12)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, t, "en", "s1", len(t)) for k, t in enumerate(clean)]
    rows += [(None, clean[0] + "\n" + items[0][1], "en", "s1", 3), rows[2], rows[2], (None, None, "en", "s1", 0), (8, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = {"_id": "'a'", "_host": "'keep'", "_path": "1", "kept": "false", "posterior": "0.5D", "_doc": "3", "n_lines": "4", "N_REMOVED": "5", "_pair": "6", "_row_a": "7", "component_id": "8", "node": "9", "_kept": "10"}
    docs = docs.selectExpr("*", *[f"{v} AS {k}" for k, v in more.items()])
    odd = {k.lower(): docs.first()[k] for k in more}
    got = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, root)
        assert after.columns == docs.columns
        got[name] = after.collect()
        assert all({k.lower(): r[k] for k in more} == odd for r in got[name]), name
    assert {r.text for r in got["quality_classifier"]} >= set(clean)
    assert {x for r in got["line_dedup"] for x in r.text.split("\n") if x} == {*clean, items[0][1]}
    near = [r.text for r in got["near_duplicates"]]
    assert {t for t in near if t} >= set(clean[1:]) and len([t for t in near if not t]) == 1 and near.count(clean[2]) == 1
    assert len(got["benchmark_decontamination"]) == len(rows) - 1


def test_empty_tables(spark, tables):
    root, _ = tables
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0
