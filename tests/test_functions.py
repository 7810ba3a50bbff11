import random

import pytest
from pyspark.sql import functions as F

from veilgrove.functions import numbers as N
from veilgrove.functions import paillier as H
from veilgrove.functions import scalar as S
from veilgrove.operators import graph as G
from veilgrove.operators import metrics as M
from veilgrove.operators import prep as P
from veilgrove.operators import privacy as D
from veilgrove.operators import split as SP
from veilgrove.storage import cut

PAIRS = [(2, 0), (7, 0), (7, 2), (4, 1), (5, 1), (5, 4), (6, 3)]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    got = one(spark, *S.softmax([F.lit(float(k)) for k in range(1, 6)]))
    assert list(got) == pytest.approx([0.01165623, 0.03168492, 0.08612854, 0.23412166, 0.63640865], abs=1e-7)
    assert one(spark, S.ce_loss(F.lit(2), S.softmax([F.lit(float(k)) for k in range(1, 6)])))[0] == pytest.approx(2.4519143105)
    assert one(spark, S.gini([F.lit(3), F.lit(5)]))[0] == pytest.approx(0.46875)
    assert one(spark, S.sigmoid(F.lit(1000.0)), S.sigmoid(F.lit(-1000.0))) == pytest.approx((1, 0))
    assert one(spark, S.pair_key(F.lit(92), F.lit(23)))[0] == 8579
    assert one(spark, S.entropy(F.lit(4), F.lit(0)), S.entropy(F.lit(4), F.lit(2))) == (0.0, 1.0)


@pytest.mark.parametrize("blocks", [2, 64])
def test_running_sums_in_blocks(spark, blocks):
    rng = random.Random(blocks)
    rows = [(k, rng.choice([0.0, -1.5, rng.random()]), rng.randint(1, 5)) for k in (1, 2) for _ in range(300)]
    hist = spark.createDataFrame(rows, "k int, x double, n int").groupBy("k", "x").agg(F.sum("n").alias("n"))
    got = SP.cumulative(hist, ["k"], "x", ["n"], blocks).collect()
    for r in got:
        assert r.cum_n == sum(n for k, x, n in rows if k == r.k and x <= r.x)


def test_hazen(spark):
    hist = spark.createDataFrame([(0, float(x), 1) for x in range(1, 12)], "k int, x double, n long")
    got = {r.i: r.t for r in SP.hazen(hist, ["k"], 4).collect()}
    assert [got[i] for i in (1, 2, 3)] == [3.25, 6.0, 8.75]


def test_auc_with_ties(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0.2, 0.3, 0.6, 0.8, 0.4, 0.5, 0.7, 0.9], strict=True)), "y int, s double")
    assert M.auc(df, "s", F.col("y") == 1).first()[0] == 0.6875
    tied = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0)], "y int, s double")
    assert M.auc(tied, "s", F.col("y") == 1).first()[0] == 0.5
    assert M.auc(tied.where("y = 0"), "s", F.col("y") == 1).first()[0] is None


def test_graph_of_eight_nodes(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in PAIRS], "src long, dst long, w double")
    k = {r.node: r.k for r in G.degrees(e).collect()}
    assert k[0] == k[2] == 2 and k[3] == 1 and sum(k.values()) == 14
    alone = spark.createDataFrame([(i, i) for i in range(8)], "node long, comm long")
    assert G.modularity(e, alone).first()[0] == pytest.approx(-0.1326530612)
    found = {}
    for r in G.louvain(e, cut).collect():
        found.setdefault(r.comm, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [[0, 2, 7], [1, 4, 5], [3, 6]]
    roots = {r.row_id: r.root for r in G.components(e, cut, spark.range(9).withColumnRenamed("id", "row_id")).collect()}
    assert roots == {0: 0, 2: 0, 7: 0, 1: 1, 4: 1, 5: 1, 3: 3, 6: 3, 8: 8}


def test_perfect_clusters(spark):
    t = spark.createDataFrame([(0, 5, 3), (1, 6, 4)], "y int, c int, n long")
    assert list(M.cluster_scores(t, "y", "c").first()) == pytest.approx([1] * 7)


def test_preparation(spark):
    assert P.even_split(3, 8) == [3, 3, 2]
    parties = P.allocate_columns(list(range(10)), 0.01)
    assert len(parties[0]) == 1 and sorted(parties[0] + parties[1]) == list(range(10))
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(40)], "id long, y int")
    with pytest.raises(ValueError):
        P.balanced_sample(df, "y", 20, [F.col("id")])
    assert one(spark, P.decimal_comma(F.lit("1,62")))[0] == 1.62
    const = P.min_max(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a"])
    assert [r.a for r in const.collect()] == [0.0, 0.0]


def test_randomised_answers(spark):
    k, order = D.k_star([0.1, 0.6, 0.3], 1.0)
    assert order == [1, 2, 0] and k == 2
    p = F.array(*map(F.lit, [0.1, 0.6, 0.3]))
    got = one(spark, D.ranked(p).alias("o"), D.k_star_column(p, 1.0).alias("k"))
    assert got.o == order and got.k == k
    df = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("y"), D.uniform(F.col("id"), 1).alias("u"), D.uniform(F.col("id"), 2).alias("v"))
    kept = df.where("y < 2").select((D.randomised(F.col("y"), F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(3), 1.0, F.col("u"), F.col("v"), 3) == F.col("y")).cast("int").alias("k")).agg(F.avg("k")).first()[0]
    assert kept == pytest.approx(2.71828 / 4.71828, abs=0.02)


def test_numbers():
    assert [pow(17, 20, 17345), pow(23, 19, 1)] == [13896, 0]
    assert all(N.is_prime(p) for p in (2, 3, 5, 1223, 9973, 99991, 524287, 2147483647))
    assert not any(N.is_prime(p) for p in (0, 1, 75361, 512461, 1565912117761))
    assert N.positive_mod(-13, 15) == 2 and N.inverse(3, 11) == 4 and N.inverse(2, 4) == 0
    g, x, y = N.extended_gcd(240, 46)
    assert (g, 240 * x + 46 * y) == (2, 2)
    assert N.prime_of(40, random.Random(1)).bit_length() == 40


def test_paillier():
    pub, sec = H.keys_of(19, 23, 4)
    rng = random.Random(3)
    three, eight = H.seal(pub, 3, rng), H.seal(pub, 8, rng)
    assert H.open_(sec, H.plus(pub, three, eight)) == 11
    assert H.open_(sec, H.times(pub, three, 0)) == 0 and H.open_(sec, H.times(pub, three, 3)) == 9
    pub, sec = H.keypair(128, seed=1)
    x = H.seal(pub, -15, rng)
    assert [H.open_(sec, H.plus_plain(pub, x, v)) for v in (1, -1)] == [-14, -16]
    assert H.open_(sec, H.times(pub, x, -1)) == 15
    f = H.seal(pub, 15.5, rng)
    assert H.open_(sec, H.plus_plain(pub, f, 0.3)) == pytest.approx(15.8)
    assert H.open_(sec, H.times(pub, H.seal(pub, 0.3, rng), 0.5)) == pytest.approx(0.15)
    assert H.open_(sec, H.blind(pub, f)) == 15.5 and H.blind(pub, f) != f
    with pytest.raises(OverflowError):
        H.seal(pub, pub.n)


def test_encrypted_sums(spark):
    pub, sec = H.keypair(128, seed=2)
    df = spark.createDataFrame([(k % 3, k - 50, k / 8) for k in range(100)], "k long, v long, f double").repartition(4)
    got = H.sum_by(df.select("k", H.encrypt(pub)("v").alias("c")), ["k"], "c", pub).select("k", H.decrypt(sec)("c").alias("s"))
    assert {r.k: r.s for r in got.collect()} == {r.k: r.s for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    two = df.select((F.col("v") + F.col("f")).alias("w"), H.decrypt(sec)(H.add(pub)(H.encrypt(pub)("v"), H.reblind(pub)(H.encrypt(pub)("f")))).alias("s")).collect()
    assert all(r.w == pytest.approx(r.s) for r in two)
