import math

import pytest
from pyspark.sql import functions as F

from veilgrove.frame import frame
from veilgrove.plans import grow as G

ROWS = [(0, 12.0, 1.0, 1), (1, 32.0, 1.0, 0), (2, 15.0, 0.0, 1), (3, 24.0, 0.0, 0), (4, 20.0, 1.0, 1), (5, 25.0, 1.0, 1), (6, 17.0, 0.0, 0), (7, 16.0, 1.0, 1)]


@pytest.fixture(scope="module")
def eight(spark):
    df = spark.createDataFrame(ROWS, "id long, a double, b double, label int")
    return frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))], [("f1", F.col("b"))]], 2)


def rows_at(vf, model, tree):
    out = {}
    for r in G.assignments(vf, model).where(F.col("tree") == tree).collect():
        out.setdefault(r.node, set()).add(r.row_id)
    return out


def test_forest_on_the_eight_rows(eight):
    m = G.fit_forest(eight, G.Params(trees=1, depth=2))
    root = m.nodes[0, 1]
    assert (root.party, root.feature, root.threshold) == (0, 0, 16.0)
    assert root.score == pytest.approx(0.16875)
    right = m.nodes[0, 3]
    assert (right.party, right.threshold) == (1, 0.0)
    assert rows_at(eight, m, 0) == {2: {0, 2, 7}, 6: {3, 6}, 7: {1, 4, 5}}
    got = {r.row_id: r.p1 for r in G.predict(eight, m).collect()}
    assert [got[i] for i in range(8)] == pytest.approx([1, 2 / 3, 1, 0, 2 / 3, 2 / 3, 0, 1])
    assert G.leaf_purity(m, 8, 0) == pytest.approx(7 / 8)


def test_boosting_on_the_eight_rows(eight):
    m = G.fit_boosting(eight, G.Params(trees=2, depth=3, rate=0.4, init=1.0))
    assert m.lookup_sizes() == {0: 4, 1: 2}
    root = m.nodes[0, 1]
    assert (root.party, root.threshold) == (0, 16.0)
    assert m.nodes[0, 2].value[0] == pytest.approx(0.5074890528)
    assert (m.nodes[0, 3].party, m.nodes[0, 7].party, m.nodes[0, 7].threshold) == (1, 0, 25.0)
    assert m.nodes[0, 3].value[0] == pytest.approx(-0.8347166358) or not m.nodes[0, 3].leaf
    assert m.nodes[0, 14].value[0] == pytest.approx(0.3860706493)
    assert m.nodes[0, 15].value[0] == pytest.approx(-0.6109404046)
    got = {r.row_id: r.p1 for r in G.predict(eight, m).collect()}
    want = [0.79959955, 0.62996684, 0.79959955, 0.55699226, 0.78498478, 0.78498478, 0.55699226, 0.79959955]
    assert [got[i] for i in range(8)] == pytest.approx(want, abs=1e-6)
    raw = eight.data.select("row_id", *[x.alias("s") for x in G.logits(m)]).collect()
    assert {r.row_id: r.s for r in raw}[0] == pytest.approx(1.38379341, abs=1e-6)
    assert m.nodes[0, 14].not_splitted and m.nodes[0, 15].not_splitted


def test_options(eight, spark):
    assert G.fit_forest(eight, G.Params(trees=0)).n_trees == 0
    assert [r.p0 for r in G.predict(eight, G.fit_forest(eight, G.Params(trees=0))).collect()] == [0.5] * 8
    only = G.fit_boosting(eight, G.Params(trees=1, depth=3, secure_rounds=1))
    assert set(only.lookup_sizes()) == {0}
    bound = G.fit_forest(eight, G.Params(trees=1, depth=3, mi_bound=0.01))
    assert 1 not in bound.lookup_sizes()
    leaf = G.fit_forest(eight, G.Params(trees=1, depth=3, min_leaf=4))
    assert all(x.n >= 4 for x in leaf.nodes.values())
    more = G.fit_boosting(eight, G.Params(trees=1, depth=2), start=G.fit_boosting(eight, G.Params(trees=1, depth=2)))
    twice = G.fit_boosting(eight, G.Params(trees=2, depth=2))
    assert {k: v.value for k, v in more.nodes.items()} == {k: v.value for k, v in twice.nodes.items()}
    binned = G.fit_forest(eight, G.Params(trees=1, depth=2, bins=64))
    assert binned.nodes[0, 1].threshold == 16.0
    sampled = G.fit_forest(eight, G.Params(trees=3, depth=2, row_ratio=0.5, col_ratio=0.5))
    assert sampled.n_trees == 3
    with pytest.raises(ValueError):
        G.Params(row_ratio=0)


def test_missing_values_are_routed_as_they_were_counted(spark):
    rows = [(i, None if i % 3 == 0 else float(i), int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, label int")
    vf = frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))]], 2)
    m = G.fit_forest(vf, G.Params(trees=1, depth=4, use_missing=True))
    for node, ids in rows_at(vf, m, 0).items():
        assert len(ids) == m.nodes[0, node].n
    got = {r.row_id: r.p1 for r in G.predict(vf, m).collect()}
    assert all((got[i] > 0.5) == (i % 3 == 0) for i in range(30))


def test_many_classes(spark):
    df = spark.createDataFrame([(i, float(i), i // 10) for i in range(30)], "id long, a double, label int")
    vf = frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))]], 3)
    m = G.fit_boosting(vf, G.Params(trees=2, depth=3, rate=0.5))
    got = G.predict(vf, m).collect()
    assert all(max(range(3), key=lambda k: r[f"p{k}"]) == r.y and math.isclose(r.p0 + r.p1 + r.p2, 1) for r in got)


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, float(i * 7 % 101), float(i * 13 % 97), int((i * 7 % 101) + (i * 13 % 97) * (i % 5) > 150)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    return frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))], [("f1", F.col("b"))]], 2)


def test_row_samples_have_exactly_their_size(many):
    p = G.Params(trees=3, depth=0, row_ratio=0.37, seed=4)
    m = G.fit_forest(many, p)
    assert [x.n for x in m.nodes.values()] == [int(0.37 * 1200)] * 3
    fine = G.draw(many.data, p, [0, 1, 2], "row_id", few=3)
    assert fine == m.drawn and len(set(fine.values())) == 3


def test_trees_under_a_bound_are_those_grown_alone(many):
    for bound in (0.02, 0.1):
        together = G.fit_forest(many, G.Params(trees=4, depth=2, row_ratio=0.2, mi_bound=bound))
        for t in range(4):
            alone = G.fit_forest(many, G.Params(trees=1, depth=2, row_ratio=0.2, mi_bound=bound, seed=t))
            mine = {n: (x.party, x.threshold, x.counts) for (tree, n), x in together.nodes.items() if tree == t}
            assert mine == {n: (x.party, x.threshold, x.counts) for (_, n), x in alone.nodes.items()}


def test_the_log(many):
    m = G.fit_boosting(many, G.Params(trees=3, depth=2), log_loss=True)
    got = G.log_frame(many.data, m).collect()
    assert [r.round for r in got] == [0, 1, 2] and got[0].loss > got[1].loss > got[2].loss
    assert all(0.5 <= r.purity <= 1 and r.leaves <= 4 and r.rows == 1200 for r in got)
