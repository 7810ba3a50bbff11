import pytest
from pyspark.sql import functions as F

from tests.test_grow import ROWS
from veilgrove.frame import frame
from veilgrove.plans import attack as A
from veilgrove.plans import defend as D
from veilgrove.plans import grow as G
from veilgrove.sources import codec as C
from veilgrove.storage import cut


@pytest.fixture(scope="module")
def eight(spark):
    df = spark.createDataFrame(ROWS, "id long, a double, b double, label int")
    return frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))], [("f1", F.col("b"))]], 2)


CLIQUES = {(2, 0), (7, 0), (7, 2), (4, 1), (5, 1), (5, 4), (6, 3)}


def test_adjacency_of_both_models(eight):
    forest = G.fit_forest(eight, G.Params(trees=1, depth=2))
    assert {(r.src, r.dst) for r in A.adjacency(eight, forest).collect()} == CLIQUES
    boost = G.fit_boosting(eight, G.Params(trees=2, depth=3, rate=0.4, init=1.0))
    got = {(r.src, r.dst): r.w for r in A.adjacency(eight, boost, eta=0.3).collect()}
    assert set(got) == CLIQUES and all(w == pytest.approx(1.3) for w in got.values())
    roots = {r.row_id: r.root for r in A.union_attack(eight, boost, cut).collect()}
    assert roots == {0: 0, 2: 0, 7: 0, 1: 1, 4: 1, 5: 1, 3: 3, 6: 3}
    assert A.adjacency(eight, forest, chunk=2).count() < len(CLIQUES) + 3
    assert A.singleton_ratio(eight, forest).first()[0] == 0.0
    merged = A.visible(forest, 0, free_rider=True)
    assert merged[6] == merged[7] == 3


def test_staged_noise_and_repair(spark):
    rows = [(i, float(i % 40), float(i % 7), int(i % 40 < 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    vf = frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))], [("f1", F.col("b"))]], 2)
    model, noised = D.staged_noise(vf, G.Params(trees=2, depth=2), 2.0, cut, stages=2)
    assert model.n_trees == 2 and noised.data.count() == 400
    same = noised.data.withColumnRenamed("y", "z").join(vf.data.select("row_id", "y"), "row_id").where("z = y").count()
    assert 280 < same < 400
    flipped = vf.data.select("row_id", F.when(F.col("f0") < 10, 1 - F.col("y")).otherwise(F.col("y")).alias("z"))
    bad = vf._replace(data=vf.data.drop("y").join(flipped.withColumnRenamed("z", "y"), "row_id"))
    wrong = G.fit_forest(bad, G.Params(trees=1, depth=3))
    right = D.repair(vf, wrong, flipped)
    acc = lambda m: G.predict(vf, m).where((F.col("p1") > 0.5).cast("int") == F.col("y")).count()
    assert acc(right) > acc(wrong)


def test_codec(spark, eight):
    text = C.to_text(eight, eight)
    train, val = C.from_text(spark, text)
    assert train.features == tuple(f._replace(name=f"f{f.feature_id}") for f in eight.features)
    for back in (train, val):
        assert sorted(map(tuple, back.data.collect())) == sorted((i, y, a, b) for i, a, b, y in ROWS)
    e = spark.createDataFrame([(a, b, 1.5) for a, b in CLIQUES], "src long, dst long, w double")
    lines = C.adjacency_lines(e, spark.range(9).withColumnRenamed("id", "node"))
    assert lines.count() == 9
    assert {(r.src, r.dst, r.w) for r in C.adjacency_edges(lines).collect()} == {(a, b, 1.5) for a, b in CLIQUES}
    comm = spark.createDataFrame([(k, k % 3) for k in range(7)], "node long, comm long")
    assert {tuple(r) for r in C.community_rows(C.community_lines(comm)).collect()} == {(k, k % 3) for k in range(7)}
    log = spark.createDataFrame([("round 1: train loss: 0.5",), ("round 2: train loss: 0.25",), ("other",)], "value string")
    assert [tuple(r) for r in C.log_values(log, "loss").collect()] == [(1, 0.5), (2, 0.25)]
    m = G.fit_forest(eight, G.Params(trees=1, depth=2))
    assert "f0 <= 16" in C.tree_text(m, 0) and '"children"' in C.tree_json(m, 0)


def test_text_formats_of_results(spark, eight, tmp_path):
    import numpy as np

    roots = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "row_id long, root long")
    assert C.union_line(roots).first().line == "0 1 0 "
    assert sorted(map(tuple, C.union_rows(C.union_line(roots)).collect())) == [(0, 0), (1, 1), (2, 0)]
    m = G.fit_boosting(eight, G.Params(trees=2, depth=2), log_loss=True)
    lines = C.log_lines(G.log_frame(eight.data, m))
    assert {r.round: round(r.value, 9) for r in C.log_values(lines, "loss").collect()} == {k: round(e["loss"], 9) for k, e in enumerate(m.log)}
    assert " *\n" in C.tree_text(G.fit_forest(eight, G.Params(trees=1, depth=2)), 0, purity=True)
    np.save(tmp_path / "fti.npy", np.array([0.5, 0.25]))
    assert sorted(map(tuple, C.feature_scores(spark, str(tmp_path / "fti.npy")).collect())) == [(0, 0.5), (1, 0.25)]
    report = spark.createDataFrame([("auc", 0.5, 0.125)], "metric string, mean double, std double")
    assert C.report_markdown(report) == "| metric | mean | std |\n| - | - | - |\n| auc | 0.5000 | 0.1250 |\n"
    C.report_csv(report, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).first().mean == "0.5"


def test_links_and_targets(eight):
    forest = G.fit_forest(eight, G.Params(trees=1, depth=2))
    plain = {(r.src, r.dst): r.w for r in A.adjacency(eight, forest, chunk=2).collect()}
    assert max(plain.values()) == A.LINK and {w for w in plain.values()} == {1.0, A.LINK}
    boost = G.fit_boosting(eight, G.Params(trees=2, depth=3, rate=0.4, init=1.0))
    assert A.visible(boost, 0)[14] == A.visible(boost, 0)[15] == 7
    assert A.visible(boost, 0, target=False)[14] == 14
