"""Queries of trained models, privacy defences and cryptography."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove import frame as VF
from veilgrove.catalogue import query
from veilgrove.functions import scalar as S
from veilgrove.operators import privacy as D
from veilgrove.plans import grow as G
from veilgrove.queries import sql
from veilgrove.storage import cut

#: A depth-2 tree of fixed thresholds, for queries that must agree with SQL.
_LEAF = "CASE WHEN quantity <= 25 THEN CASE WHEN discount <= 0.05 THEN 4 ELSE 5 END ELSE CASE WHEN tax <= 0.04 THEN 6 ELSE 7 END END"


def fixed_model(frame: VF.VerticalFrame) -> G.Model:
    nodes = {(0, k): G.Node(0, k, 2 - (k > 1) - (k > 3), 0, [], leaf=k > 3) for k in range(1, 8)}
    for k, f, t in ((1, 0, 25.0), (2, 2, 0.05), (3, 3, 0.04)):
        nodes[0, k].feature, nodes[0, k].party, nodes[0, k].threshold = f, frame.features[f].party_id, t
    for k in range(4, 8):
        nodes[0, k].value = [k / 10.0, 1 - k / 10.0]
    return G.Model("forest", frame.features, 2, G.Params(trees=1, depth=2), nodes, 1, [])


def lineitem2(spark: SparkSession, d: str) -> VF.VerticalFrame:
    return VF.lineitem(spark, d, "linestatus")


@query("split_rows", f"WITH {sql.LI3} SELECT row_id, {_LEAF} AS node FROM li")
def split_rows(spark, d):
    vf = lineitem2(spark, d)
    return G.assignments(vf, fixed_model(vf)).select("row_id", "node")


@query("predict_proba", f"WITH {sql.LI3} SELECT row_id, round(({_LEAF}) / 10.0, 9)::DOUBLE AS p0 FROM li")
def predict_proba(spark, d):
    vf = lineitem2(spark, d)
    return G.predict(vf, fixed_model(vf)).select("row_id", F.round("p0", 9).alias("p0"))


@query("train_prediction", f"WITH {sql.LI3}, a AS (SELECT row_id, y2, {_LEAF} AS node FROM li) SELECT row_id, round(avg(y2) OVER (PARTITION BY node), 9) AS p FROM a")
def train_prediction(spark, d):
    vf = lineitem2(spark, d)
    placed = G.assignments(vf, fixed_model(vf))
    ratio = placed.groupBy("node").agg(F.round(F.avg("y"), 9).alias("p"))
    return placed.join(F.broadcast(ratio), "node").select("row_id", "p")


def _two_levels(table: str, features: list[tuple[int, str]], sums: str, windows: str, score: str, mixed: str) -> str:
    """Two levels of a tree in SQL, from ``scored`` on: the root's sides, and the best split of each that is not pure.

    ``features`` are party and column; ``sums`` are those of a histogram,
    ``windows`` their running sums, ``mixed`` tells that a side is not pure.
    """
    value = lambda f: "CASE " + f + " " + " ".join(f"WHEN {k} THEN {c}" for k, (_, c) in enumerate(features)) + " END"
    cells = " UNION ALL ".join(f"SELECT node, y, y2, {party} AS party_id, {k} AS feature_id, {c} AS x FROM sides" for k, (party, c) in enumerate(features))
    return (
        f", best AS (SELECT feature_id, x AS t FROM scored ORDER BY score DESC, party_id, feature_id, x LIMIT 1), sides AS (SELECT s.*, CASE WHEN {value('b.feature_id')} <= b.t THEN 2 ELSE 3 END AS node FROM {table} s, best b), "
        f"hist2 AS (SELECT node, party_id, feature_id, x, count(*) AS n, {sums} FROM ({cells}) GROUP BY ALL), "
        f"run2 AS (SELECT *, sum(n) OVER w AS cum_n, sum(n) OVER p AS tot_n, {windows} FROM hist2 WINDOW w AS (PARTITION BY node, feature_id ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feature_id)), "
        f"pick AS (SELECT * FROM (SELECT node, feature_id, x AS t, row_number() OVER (PARTITION BY node ORDER BY {score} DESC, party_id, feature_id, x) AS r FROM run2 WHERE tot_n > cum_n AND {mixed}) WHERE r = 1), "
        f"leaf AS (SELECT s.y, s.y2, CASE WHEN p.t IS NULL THEN s.node WHEN {value('p.feature_id')} <= p.t THEN 2 * s.node ELSE 2 * s.node + 1 END AS node FROM sides s LEFT JOIN pick p USING (node))"
    )


_LI = [(0, "quantity"), (0, "extendedprice"), (1, "discount"), (1, "tax")]
_CUSTOMER = [(0, "a"), (1, "b")]


def _gini2(table: str, features: list[tuple[int, str]]) -> str:
    each = ", ".join(f"sum(c{k}) OVER w AS cum_c{k}, sum(c{k}) OVER p AS tot_c{k}" for k in range(3))
    return _two_levels(table, features, ", ".join(f"sum((y = {k})::INT) AS c{k}" for k in range(3)), each, sql.SCORE, "greatest(tot_c0, tot_c1, tot_c2) < tot_n")


def _gain2(table: str, features: list[tuple[int, str]]) -> str:
    each = "(sum(g) OVER w)::DOUBLE AS gl, (sum(h) OVER w)::DOUBLE AS hl, (sum(g) OVER p)::DOUBLE AS gt, (sum(h) OVER p)::DOUBLE AS ht, sum(c) OVER p AS tot_c"
    gain = "round(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)), 9)"
    return _two_levels(table, features, "sum(0.5 - y2) AS g, sum(0.25) AS h, sum(y2) AS c", each, gain, "tot_c BETWEEN 1 AND tot_n - 1")


_LEAVES2 = "SELECT node, count(*) AS n, round(avg((y = 0)::INT), 9) AS p0, round(avg((y = 1)::INT), 9) AS p1, round(avg((y = 2)::INT), 9) AS p2 FROM leaf GROUP BY 1"


def _leaf_rows(spark: SparkSession, m: G.Model) -> DataFrame:
    return spark.createDataFrame([(x.tree, x.node, x.n, *[round(v, 9) for v in x.value]) for x in m.nodes.values() if x.leaf], "tree int, node int, n long, p0 double, p1 double, p2 double")


@query("forest_fit", f"WITH {sql.SCORED}{_gini2('li', _LI)}, l AS ({_LEAVES2}) SELECT t.tree, l.* FROM l, (SELECT unnest([0, 1])::INT AS tree) t")
def forest_fit(spark, d):
    """Two trees of depth 2 on all rows and columns."""
    return _leaf_rows(spark, G.fit_forest(VF.lineitem(spark, d), G.Params(trees=2, depth=2)))


@query("boost_fit", f"WITH {sql.XGB}{_gain2('li', _LI)} SELECT node, count(*) AS n, round((-sum(0.5 - y2) / (sum(0.25) + 1))::DOUBLE, 9) AS weight FROM leaf GROUP BY 1")
def boost_fit(spark, d):
    """The first round of two, depth 2; the second has no SQL, its own query is boosting_nodes."""
    m = G.fit_boosting(lineitem2(spark, d), G.Params(trees=2, depth=2), cut)
    return spark.createDataFrame([(x.node, x.n, round(x.value[0], 9)) for x in m.nodes.values() if x.leaf and x.tree == 0], "node int, n long, weight double")


def _keys():
    from veilgrove.functions import paillier as H
    from veilgrove.plans import secure as E

    return E.Keys(*H.keypair(KEY_BITS, seed=5))


def customers(spark: SparkSession, d: str) -> VF.VerticalFrame:
    """Party 0: nation; party 1: balance in hundreds.  Label: which of three groups a segment is in."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    y = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") < "F", 1).otherwise(2)
    return VF.frame(df, F.col("c_custkey"), y, [[("nation", F.col("c_nationkey"))], [("balance", F.floor(F.col("c_acctbal") / 100))]], 3)


#: The customers as cells, for the SQL of a whole tree.
_CU = (
    "cu AS (SELECT c_custkey AS row_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment < 'F' THEN 1 ELSE 2 END AS y, (c_mktsegment = 'BUILDING')::INT AS y2, c_nationkey::DOUBLE AS a, floor(c_acctbal / 100)::DOUBLE AS b FROM customer), "
    "cells AS (SELECT row_id, y, y2, 0 AS party_id, 0 AS feature_id, a AS x FROM cu UNION ALL SELECT row_id, y, y2, 1, 1, b FROM cu)"
)


@query("secure_forest_fit", f"WITH {_CU}{sql.after('cells', sql.SCORED)}{_gini2('cu', _CUSTOMER)} {_LEAVES2}")
def secure_forest_fit(spark, d):
    """A tree of depth 2 whose passive party adds up sealed class marks: the splits that plain counts give."""
    from veilgrove.plans import secure as E

    return _leaf_rows(spark, E.fit_forest(customers(spark, d), G.Params(trees=1, depth=2), _keys())).drop("tree")


@query("secure_boost_fit", f"WITH {_CU}{sql.after('cells', sql.XGB)}{_gain2('cu', _CUSTOMER)} SELECT node, count(*) AS n, round((-sum(0.5 - y2) / (sum(0.25) + 1))::DOUBLE, 9) AS weight FROM leaf GROUP BY 1")
def secure_boost_fit(spark, d):
    """A round of depth 2 whose passive party adds up sealed gradients and hessians."""
    from veilgrove.plans import secure as E

    vf = customers(spark, d)
    vf = vf._replace(data=vf.data.withColumn("y", (F.col("y") == 0).cast("int")), num_classes=2)
    m = E.fit_boosting(vf, G.Params(trees=1, depth=2), _keys())
    return spark.createDataFrame([(x.node, x.n, round(x.value[0], 9)) for x in m.nodes.values() if x.leaf], "node int, n long, weight double")


@query("secure_traffic")
def secure_traffic(spark, d):
    """What a run of two trees over a network would send."""
    from veilgrove.plans import secure as E

    vf = customers(spark, d)
    return E.traffic(vf.data, G.fit_forest(vf, G.Params(trees=2, depth=3)))


@query("boosting_log")
def boosting_log(spark, d):
    """Loss, rows, leaves, purity and offers of each round."""
    vf = lineitem2(spark, d)
    return G.log_frame(vf.data, G.fit_boosting(vf, G.Params(trees=3, depth=3, bins=32), cut, log_loss=True))


_ROOT = "b AS (SELECT feature_id, x FROM scored WHERE {least} ORDER BY score DESC, party_id, feature_id, x LIMIT 1), side AS (SELECT c.y, c.y2, CASE WHEN c.x <= b.x THEN 2 ELSE 3 END AS node FROM cells c JOIN b USING (feature_id))"


@query("rf_leaf_value", f"WITH {sql.SCORED}, {_ROOT.format(least='cum_n >= 2000 AND tot_n - cum_n >= 2000')} SELECT node, count(*) AS n, round(avg((y = 0)::INT), 9) AS p0, round(avg((y = 1)::INT), 9) AS p1, round(avg((y = 2)::INT), 9) AS p2 FROM side GROUP BY 1")
def rf_leaf_value(spark, d):
    """Leaves of a tree of depth 1 with a least size."""
    return _leaf_rows(spark, G.fit_forest(VF.lineitem(spark, d), G.Params(trees=1, depth=1, min_leaf=2000))).drop("tree")


@query("min_child_weight", f"WITH {sql.XGB}, {_ROOT.format(least='hl >= 500 AND ht - hl >= 500')} SELECT node, count(*) AS n, round((-sum(0.5 - y2) / (sum(0.25) + 1))::DOUBLE, 9) AS weight FROM side GROUP BY 1")
def min_child_weight(spark, d):
    """Leaves of a round of depth 1 with a least sum of hessians."""
    m = G.fit_boosting(lineitem2(spark, d), G.Params(trees=1, depth=1, min_child_weight=500))
    return spark.createDataFrame([(x.node, x.n, round(x.value[0], 9)) for x in m.nodes.values() if x.leaf], "node int, n long, weight double")


@query("xgb_depth2_left_rows", f"WITH {sql.XGB}{_gain2('li', _LI)} SELECT node, count(*) AS n, sum(y2)::BIGINT AS ones FROM leaf GROUP BY 1")
def left_rows(spark, d):
    """Rows that the first round's tree of depth 2 sends to each leaf."""
    vf = lineitem2(spark, d)
    m = G.fit_boosting(vf, G.Params(trees=1, depth=2), cut)
    return G.assignments(vf, m).groupBy("node").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))


_EV = "ev AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS x, (event_type = 'click')::INT AS y FROM events)"
_GINI = "1 - pow(({p})::DOUBLE / nullif({n}, 0), 2) - pow(1 - ({p})::DOUBLE / nullif({n}, 0), 2)"


def _missing_sql() -> str:
    g = lambda n, p: f"coalesce({_GINI.format(n=n, p=p)}, 0)"
    return (
        f"WITH {_EV}, h AS (SELECT x, count(*) AS n, sum(y) AS p FROM ev WHERE x IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS n, sum(y) AS p, count(*) - count(x) AS mn, coalesce(sum(y) FILTER (x IS NULL), 0) AS mp FROM ev), "
        "r AS (SELECT x, sum(h.n) OVER w AS n, sum(h.p) OVER w AS p, t.n AS tn, t.p AS tp, mn, mp FROM h, t WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), "
        "c AS (SELECT x, false AS missing_left, n, p, tn, tp FROM r UNION ALL SELECT x, true, n + mn, p + mp, tn, tp FROM r WHERE mn > 0), "
        f"z AS (SELECT *, round({g('tn', 'tp')} - n::DOUBLE / tn * {g('n', 'p')} - (1 - n::DOUBLE / tn) * {g('(tn - n)', '(tp - p)')}, 9) AS score FROM c WHERE n < tn) "
        "SELECT x AS threshold, missing_left, n::BIGINT AS n_left, score FROM z ORDER BY score DESC, missing_left, x LIMIT 1"
    )


@query("missing_split_fit", _missing_sql())
def missing_split_fit(spark, d):
    """The root's split of a tree on one feature with missing values, each side tried for these."""
    vf = VF.events(spark, d)
    vf = vf._replace(data=vf.data.withColumn("y", (F.col("y") == 0).cast("int")), features=vf.features[:1], num_classes=2)
    m = G.fit_forest(vf, G.Params(trees=1, depth=1, use_missing=True))
    x = m.nodes[0, 1]
    return spark.createDataFrame([(x.threshold, x.missing_left, m.nodes[0, 2].n, x.score)], "threshold double, missing_left boolean, n_left long, score double")


def nodes_frame(spark: SparkSession, m: G.Model) -> DataFrame:
    rows = [(x.tree, x.node, x.leaf, x.party, x.feature, x.threshold, x.n, [float(v) for v in x.value], x.restricted, x.not_splitted) for x in m.nodes.values()]
    return spark.createDataFrame(rows, "tree int, node int, leaf boolean, party int, feature int, threshold double, n long, value array<double>, restricted boolean, not_splitted boolean")


@query("forest_nodes")
def forest_nodes(spark, d):
    return nodes_frame(spark, G.fit_forest(VF.embeddings(spark, d), G.Params(trees=3, depth=3, col_ratio=0.8, row_ratio=0.8, bins=32)))


@query("boosting_nodes")
def boosting_nodes(spark, d):
    return nodes_frame(spark, G.fit_boosting(lineitem2(spark, d), G.Params(trees=2, depth=3, bins=32), cut))


@query("secure_rounds")
def secure_rounds(spark, d):
    return nodes_frame(spark, G.fit_boosting(lineitem2(spark, d), G.Params(trees=2, depth=2, bins=32, secure_rounds=1), cut))


# -- privacy ------------------------------------------------------------------------------------------
def _kl(counts: list[str], total: str, prior: list[str]) -> str:
    each = " + ".join(f"({c})::DOUBLE / nullif({total}, 0) * ln(1e-15 + (({c})::DOUBLE / nullif({total}, 0)) / ({p}))" for c, p in zip(counts, prior, strict=True))
    return f"CASE WHEN {total} > 0 THEN {each} ELSE 0 END"


_PRIOR = [f"tot_c{k}::DOUBLE / tot_n" for k in range(3)]
_IN = _kl([f"cum_c{k}" for k in range(3)], "cum_n", _PRIOR)
_OUT = _kl([f"tot_c{k} - cum_c{k}" for k in range(3)], "(tot_n - cum_n)", _PRIOR)


@query("lmir_bound", f"WITH {sql.CUM} SELECT party_id, feature_id, x, round(greatest({_IN}, {_OUT}), 6) + 0 AS xi FROM run")
def lmir_bound(spark, d):
    from veilgrove.operators import split as P
    from veilgrove.queries.splits import COLS, KEYS, hist3

    run = P.cumulative(hist3(spark, d), KEYS, "x", COLS)
    run = run.join(P.totals(hist3(spark, d), KEYS, COLS), KEYS)
    xi = D.lmir([F.col(f"cum_c{k}") for k in range(3)], [F.col(f"tot_c{k}") for k in range(3)])
    return run.select(*KEYS, "x", (F.round(xi, 6) + 0).alias("xi"))


@query("lmir_candidate_filter", f"WITH {sql.CUM} SELECT party_id, feature_id, count(*) AS n FROM run WHERE tot_n > cum_n AND (party_id = 0 OR round(greatest({_IN}, {_OUT}), 6) <= 0.00001) GROUP BY ALL")
def lmir_filter(spark, d):
    from veilgrove.operators import split as P
    from veilgrove.queries.splits import COLS, KEYS, hist3

    cand = P.candidates(hist3(spark, d), KEYS, COLS)
    xi = F.round(D.lmir([F.col(f"cum_c{k}") for k in range(3)], [F.col(f"tot_c{k}") for k in range(3)]), 6)
    return cand.where((F.col("party_id") == 0) | (xi <= 0.00001)).groupBy(*KEYS).agg(F.count("*").alias("n"))


EPSILON = 1.0
_RR = f"c AS (SELECT c_mktsegment AS k, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1), o AS (SELECT k, p, row_number() OVER (ORDER BY p DESC, k) AS r, sum(p) OVER (ORDER BY p DESC, k ROWS UNBOUNDED PRECEDING) AS cum FROM c), w AS (SELECT r, exp({EPSILON}) / (exp({EPSILON}) + r - 1) * cum AS w FROM o)"


@query("rr_kstar", f"WITH {_RR} SELECT r::INT AS k_star, round(w, 9) AS w FROM w ORDER BY w DESC, r LIMIT 1")
def rr_kstar(spark, d):
    prior = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()
    n = sum(r["count"] for r in prior)
    shares = [r["count"] / n for r in prior]
    k, order = D.k_star(shares, EPSILON)
    w = math.exp(EPSILON) / (math.exp(EPSILON) + k - 1) * sum(shares[o] for o in order[:k])
    return spark.createDataFrame([(k, round(w, 9))], "k_star int, w double")


_U, _V = "((doc_id * 7919 + 11) % 1000) / 1000.0", "((doc_id * 104729 + 5) % 997) / 997.0"


@query("rr_topk_draw", f"SELECT doc_id, CASE WHEN ({_U})::DOUBLE < exp(1.0) / (exp(1.0) + 1) THEN quality ELSE 1 - quality END::INT AS noised FROM labels WHERE quality IS NOT NULL")
def rr_topk_draw(spark, d):
    df = spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL").withColumn("y", F.col("quality").cast("int"))
    u = F.expr(f"cast({_U} AS double)")
    v = F.expr(f"cast({_V} AS double)")
    return df.select("doc_id", D.randomised(F.col("y"), F.array(F.lit(1), F.lit(0)), F.lit(2), EPSILON, u, v, 2).cast("int").alias("noised"))


@query("lpmst_chunks", f"SELECT doc_id, (doc_id % 2)::INT AS chunk, CASE WHEN doc_id % 2 = 1 THEN 0 WHEN ({_U})::DOUBLE < exp(1.0) / (exp(1.0) + 1) THEN toxic ELSE 1 - toxic END::INT AS noised FROM labels WHERE toxic IS NOT NULL")
def lpmst_chunks(spark, d):
    """Both chunks of all labelled rows: the first under a uniform prior, the second under one so sure of class 0 that only this is answered."""
    df = spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").withColumn("y", F.col("toxic").cast("int"))
    prior = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.8), F.lit(0.2)))
    drawn = D.randomised(F.col("y"), D.ranked(prior), D.k_star_column(prior, EPSILON), EPSILON, F.expr(f"cast({_U} AS double)"), F.expr(f"cast({_V} AS double)"), 2)
    return df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("chunk"), drawn.cast("int").alias("noised"))


@query("lmir_fit", f"WITH {sql.CUM}, s AS (SELECT *, {sql.SCORE} AS score FROM run WHERE tot_n > cum_n AND (party_id = 0 OR greatest({_IN}, {_OUT}) <= 0.00001)) SELECT party_id AS party, feature_id AS feature, x AS threshold, cum_n::BIGINT AS n_left, score FROM s ORDER BY score DESC, party_id, feature_id, x LIMIT 1")
def lmir_fit(spark, d):
    """The root's split under a bound on what passive parties' splits tell."""
    m = G.fit_forest(VF.lineitem(spark, d), G.Params(trees=1, depth=1, mi_bound=0.00001))
    x = m.nodes[0, 1]
    return spark.createDataFrame([(x.party, x.feature, x.threshold, m.nodes[0, 2].n, x.score)], "party int, feature int, threshold double, n_left long, score double")


@query("lmir_ratios", f"WITH {sql.CUM} SELECT party_id, feature_id, x, round(greatest({_IN}, {_OUT}), 6) <= 0.00001 AS passes FROM run WHERE tot_n > cum_n")
def lmir_ratios(spark, d):
    """The bound tested on class shares, as from opened ratios, in place of counts."""
    from veilgrove.operators import split as P
    from veilgrove.plans import secure as E
    from veilgrove.queries.splits import COLS, KEYS, hist3

    cand = P.candidates(hist3(spark, d), KEYS, COLS)
    left, whole = [F.col(f"cum_c{k}").cast("double") for k in range(3)], [F.col(f"tot_c{k}").cast("double") for k in range(3)]
    r = E.ratios(left, whole, whole)
    n = S.total(whole)
    return cand.select(*KEYS, "x", E.ratios_ok(r["left_in"], r["left_out"], [c / n for c in whole], 0.0000105).alias("passes"))


_NOISED = f"a AS (SELECT {_LEAF} AS node, y, CASE WHEN y = 0 AND quantity <= 25 THEN 2 ELSE y END AS z FROM li)"


@query("contaminated_leaves", f"WITH {sql.LI3}, {_NOISED}, c AS (SELECT node, (SELECT 1) AS o, z AS k, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT node, y AS k, count(*) AS n FROM a GROUP BY ALL), "
       "x AS (SELECT node, k FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, k) r FROM c) WHERE r = 1), y AS (SELECT node, k FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, k) r FROM t) WHERE r = 1) SELECT node, x.k <> y.k AS mismatch FROM x JOIN y USING (node)")
def contaminated(spark, d):
    vf = VF.lineitem(spark, d)
    model = fixed_model(vf)
    z = F.when((F.col("y") == 0) & (F.col("quantity") <= 25), 2).otherwise(F.col("y"))
    placed = vf.data.select("y", z.alias("z"), G.leaves(vf, model, 0).alias("node"))
    return D.mismatched(placed, ["node"], "z", "y")


#: Bits of the primes, as in the experiments of this domain.
KEY_BITS = 128


# -- cryptography -----------------------------------------------------------------------------------
@query("paillier_sum", "SELECT l_returnflag, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1")
def paillier_sum(spark, d):
    from veilgrove.functions import paillier as H

    pub, sec = H.keypair(KEY_BITS, seed=5)
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast("long").alias("v"))
    sent = df.select("l_returnflag", H.encrypt(pub, sec=sec)("v").alias("c"))
    return H.sum_by(sent, ["l_returnflag"], "c", pub).select("l_returnflag", H.decrypt(sec)("c").cast("long").alias("total"))


@query("paillier_scale_add", "SELECT o_orderkey, (o_custkey * 3 - 7)::BIGINT AS v FROM orders")
def paillier_scale_add(spark, d):
    from veilgrove.functions import paillier as H

    pub, sec = H.keypair(KEY_BITS, seed=5)
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", H.encrypt(pub, sec=sec)("o_custkey").alias("c"))
    return df.select("o_orderkey", H.decrypt(sec)(H.add_plain(pub, -7)(H.multiply(pub, 3)("c"))).cast("long").alias("v"))


_SEALED = (
    "WITH ev AS (SELECT (event_type = 'error')::INT AS y2, hour(ts)::DOUBLE AS h, user_id::DOUBLE AS u FROM events), cells AS (SELECT y2, 1 AS feature_id, h AS x FROM ev UNION ALL SELECT y2, 2, u FROM ev) "
    "SELECT feature_id, x, count(*) AS n, round(sum(0.5 - y2)::DOUBLE, 6) AS g, round(sum(0.25)::DOUBLE, 6) AS h, sum((y2 = 0)::INT)::BIGINT AS c0, sum((y2 = 1)::INT)::BIGINT AS c1 FROM cells GROUP BY ALL"
)


@query("secure_histogram", _SEALED)
def secure_histogram(spark, d):
    from veilgrove.functions import paillier as H
    from veilgrove.plans import secure as E

    vf = VF.events(spark, d)
    vf = vf._replace(data=vf.data.withColumn("y", (F.col("y") == 1).cast("int")), num_classes=2)
    p = S.sigmoid(F.lit(0.0))
    named = {"g": S.bce_gradient(F.col("y"), p), "h": S.bce_hessian(p), "c0": (F.col("y") == 0).cast("double"), "c1": (F.col("y") == 1).cast("double")}
    pub, sec = H.keypair(KEY_BITS, seed=5)
    got = E.opened(E.sealed_histogram(vf.party(1), E.sealed(vf.data, named, pub, sec=sec), list(named), pub), list(named), sec)
    return got.select("feature_id", "x", "n", F.round("g", 6).alias("g"), F.round("h", 6).alias("h"), F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"))


@query("gcd_lcm", "SELECT p_partkey, gcd(p_partkey + 1, p_size) AS g, lcm(p_partkey + 1, p_size) AS l FROM part")
def gcd_lcm(spark, d):
    from veilgrove.functions import numbers as N

    df = spark.read.parquet(f"{d}/part.parquet").withColumn("a", F.col("p_partkey") + 1)
    return df.select("p_partkey", N.gcd_udf("a", F.col("p_size").cast("long")).alias("g"), N.lcm_udf("a", F.col("p_size").cast("long")).alias("l"))


@query("modpow", "WITH RECURSIVE r(k, i, v) AS (SELECT p_partkey, 0, 1::BIGINT FROM part UNION ALL SELECT k, i + 1, v * (k % 97) % 1009 FROM r WHERE i < 13) SELECT k AS p_partkey, v FROM r WHERE i = 13")
def modpow(spark, d):
    from veilgrove.functions import numbers as N

    df = spark.read.parquet(f"{d}/part.parquet")
    return df.select("p_partkey", N.modpow_udf(F.col("p_partkey") % 97, F.lit(13).cast("long"), F.lit(1009).cast("long")).alias("v"))


@query("miller_rabin", "SELECT p_partkey, p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 50) t(q) WHERE q < p_partkey AND p_partkey % q = 0) AS prime FROM part")
def miller_rabin(spark, d):
    from veilgrove.functions import numbers as N

    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", N.is_prime_udf("p_partkey").alias("prime"))


@query("mod_inverse", "SELECT p_partkey, (SELECT coalesce(min(x), 0) FROM range(1, 101) t(x) WHERE (p_partkey % 101) * x % 101 = 1) AS inverse FROM part")
def mod_inverse(spark, d):
    from veilgrove.functions import numbers as N

    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", N.inverse_udf("p_partkey", F.lit(101).cast("long")).alias("inverse"))


# -- clustering ---------------------------------------------------------------------------------------
def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("kmeans")
def kmeans(spark, d):
    from veilgrove.operators import cluster as C

    return C.k_means(_vectors(spark, d), 10, seed=42).select("vec_id", "cluster")


@query("xmeans")
def xmeans(spark, d):
    from veilgrove.operators import cluster as C

    return C.x_means(_vectors(spark, d), cut, seed=42).select("vec_id", "cluster")


@query("xmeans_normal_law")
def xmeans_normal_law(spark, d):
    """Recursive halves that are judged by normal laws, from two clusters on, over balance and nation of the customers."""
    from pyspark.ml.functions import array_to_vector

    from veilgrove.operators import cluster as C

    df = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", array_to_vector(F.array((F.col("c_acctbal") / 1000).cast("double"), F.col("c_nationkey").cast("double"))).alias("features"))
    return C.x_means(df, cut, seed=42, begin=2, splits=C.splits_by_normal_law).select("c_custkey", "cluster")


@query("ssemeans")
def ssemeans(spark, d):
    from veilgrove.operators import cluster as C

    return C.sse_means(_vectors(spark, d)).select("vec_id", "cluster")


@query("truncated_svd")
def truncated_svd(spark, d):
    from veilgrove.operators import cluster as C

    return C.truncated_svd(_vectors(spark, d), 2).select("vec_id", F.round(F.col("sv")[0], 4).alias("sv0"), F.round(F.col("sv")[1], 4).alias("sv1"))


@query("pca")
def pca(spark, d):
    from veilgrove.operators import cluster as C

    return C.principal(_vectors(spark, d), 2).select("vec_id", F.round(F.get("pc", F.lit(0)), 4).alias("pc0"))
