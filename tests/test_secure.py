import pytest
from pyspark.sql import functions as F

from tests.test_grow import ROWS
from veilgrove.frame import frame
from veilgrove.functions import paillier as H
from veilgrove.plans import grow as G
from veilgrove.plans import secure as E


@pytest.fixture(scope="module")
def eight(spark):
    df = spark.createDataFrame(ROWS, "id long, a double, b double, label int")
    return frame(df, F.col("id"), F.col("label"), [[("f0", F.col("a"))], [("f1", F.col("b"))]], 2)


@pytest.fixture(scope="module")
def keys():
    return E.Keys(*H.keypair(128, seed=3))


def told(m):
    return {k: (x.party, x.feature, x.threshold, x.n, x.counts, [round(v, 9) for v in x.value]) for k, x in m.nodes.items()}


def test_secure_models_are_the_plain_ones(eight, keys):
    p = G.Params(trees=2, depth=2, mi_bound=0.9)
    assert told(E.fit_forest(eight, p, keys)) == told(G.fit_forest(eight, p))
    b = G.Params(trees=2, depth=3, rate=0.4, init=1.0)
    assert told(E.fit_boosting(eight, b, keys)) == told(G.fit_boosting(eight, b))


def test_traffic(eight):
    m = G.fit_forest(eight, G.Params(trees=1, depth=2))
    got = {r.message: r for r in E.traffic(eight.data, m).collect()}
    assert got["vec_encrypted_y"].ciphertexts == 16 and got["vec_encrypted_y"].tag == 0
    assert got["publickey"].messages == 1 and got["best_split_col_id"].messages == 1 and got["search_results"].ciphertexts > 0


def test_owner_and_others_seal_alike(keys):
    for noise in (H._Noise(keys.public), H._Noise(keys.public, keys.secret)):
        for v in (0, 5, -7, 2.25, -1e-3):
            assert H.open_(keys.secret, H.seal(keys.public, v, noise=noise)) == pytest.approx(v)
    pub, sec = H.keys_of(19, 23, 4)
    assert H.open_(sec, H.plus(pub, H.seal(pub, 3), H.seal(pub, 8))) == 11
