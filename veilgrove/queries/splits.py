"""Queries of split search, losses and boosting steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrove import frame as VF
from veilgrove.catalogue import query
from veilgrove.functions import scalar as S
from veilgrove.operators import split as P
from veilgrove.queries import sql

KEYS = ["party_id", "feature_id"]
COLS = ["n", "c0", "c1", "c2"]


def hist3(spark, d):
    return P.histogram(VF.lineitem(spark, d).cells(), KEYS, P.class_counts(F.col("y"), 3))


def scored3(spark, d, min_leaf=1):
    return P.gini_scores(P.candidates(hist3(spark, d), KEYS, COLS, min_leaf=min_leaf), 3)


@query("exact_thresholds", f"WITH {sql.CELLS} SELECT DISTINCT party_id, feature_id, x FROM cells")
def exact_thresholds(spark, d):
    return VF.lineitem(spark, d).cells().select(*KEYS, "x").distinct()


@query("rf_histogram", f"WITH {sql.HIST} SELECT party_id, feature_id, x, n, c0::BIGINT AS c0, c1::BIGINT AS c1, c2::BIGINT AS c2 FROM hist")
def rf_histogram(spark, d):
    return hist3(spark, d)


@query("rf_cumulative", f"WITH {sql.CUM} SELECT party_id, feature_id, x, cum_n::BIGINT AS cum_n, cum_c0::BIGINT AS cum_c0, cum_c1::BIGINT AS cum_c1, cum_c2::BIGINT AS cum_c2 FROM run")
def rf_cumulative(spark, d):
    return P.cumulative(hist3(spark, d), KEYS, "x", COLS).select(*KEYS, "x", *[f"cum_{c}" for c in COLS])


@query("gini_impurity", f"WITH {sql.LI3}, c AS (SELECT quantity, count(*) n, sum((y = 0)::INT) a, sum((y = 1)::INT) b, sum((y = 2)::INT) c FROM li GROUP BY 1) SELECT quantity, round({sql.gini('n', 'a', 'b', 'c')}, 9) AS gini FROM c")
def gini_impurity(spark, d):
    by = VF.lineitem(spark, d).data.groupBy("quantity").agg(*P.class_counts(F.col("y"), 3))
    return by.select("quantity", F.round(S.gini([F.col(f"c{k}") for k in range(3)]), 9).alias("gini"))


@query("entropy", f"WITH {sql.LI3}, c AS (SELECT quantity, sum(y2) / count(*)::DOUBLE AS p FROM li GROUP BY 1) SELECT quantity, round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END, 9) AS entropy FROM c")
def entropy(spark, d):
    by = VF.lineitem(spark, d, "linestatus").data.groupBy("quantity").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return by.select("quantity", F.round(S.entropy(F.col("n"), F.col("p")), 9).alias("entropy"))


@query("rf_best_split", f"WITH {sql.SCORED} SELECT party_id, feature_id, x, score FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, x) AS r FROM scored) WHERE r = 1")
def rf_best_split(spark, d):
    return P.best(scored3(spark, d), KEYS, ["x"], [])


@query("rf_best_split_per_party", f"WITH {sql.SCORED} SELECT party_id, feature_id, x, score FROM (SELECT *, row_number() OVER (PARTITION BY party_id ORDER BY score DESC, feature_id, x) AS r FROM scored) WHERE r = 1")
def rf_best_per_party(spark, d):
    return P.best(scored3(spark, d), ["party_id"], ["feature_id", "x"], [])


@query("rf_min_leaf", f"WITH {sql.SCORED} SELECT party_id, feature_id, count(*) AS n FROM scored WHERE cum_n >= 2000 AND tot_n - cum_n >= 2000 GROUP BY ALL")
def rf_min_leaf(spark, d):
    return scored3(spark, d, 2000).groupBy(*KEYS).agg(F.count("*").alias("n"))


_RANKED = (
    f"WITH {sql.CELLS}, o AS (SELECT feature_id, x, row_number() OVER (PARTITION BY feature_id ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY feature_id) AS n FROM cells), "
    "q AS (SELECT DISTINCT feature_id, n, i, i / 8.0::DOUBLE * n - 0.5 AS at FROM o, range(1, 9) t(i)), "
    "h AS (SELECT q.feature_id, q.i, a.x + (b.x - a.x) * (q.at - greatest(floor(q.at), 0)) AS t FROM q JOIN o a ON a.feature_id = q.feature_id AND a.rn = greatest(floor(q.at), 0) JOIN o b ON b.feature_id = q.feature_id AND b.rn = least(ceil(q.at), q.n - 1)) "
)


@query("hazen_quantiles", _RANKED + "SELECT feature_id, i::INT AS i, round(t, 6) AS t FROM h")
def hazen(spark, d):
    return P.hazen(hist3(spark, d), ["feature_id"], 8).select("feature_id", "i", F.round("t", 6).alias("t"))


@query("quantile_bins", _RANKED + "SELECT c.feature_id, (SELECT count(DISTINCT h.t) FROM h WHERE h.feature_id = c.feature_id AND h.t < c.x)::INT AS bin, count(*) AS n FROM cells c GROUP BY ALL")
def quantile_bins(spark, d):
    edges = P.hazen(hist3(spark, d), ["feature_id"], 8).groupBy("feature_id").agg(F.sort_array(F.collect_set("t")).alias("edges"))
    cells = VF.lineitem(spark, d).cells().join(F.broadcast(edges), "feature_id")
    return cells.groupBy("feature_id", P.bin_of(F.col("x"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))


# -- boosting ----------------------------------------------------------------------------------
def xgb_hist(spark, d):
    p = S.sigmoid(F.lit(0.0))
    return P.histogram(VF.lineitem(spark, d, "linestatus").cells(), KEYS, [F.sum(S.bce_gradient(F.col("y"), p)).alias("g0"), F.sum(S.bce_hessian(p)).alias("h0")])


def xgb_scored(spark, d):
    return P.gain_scores(P.candidates(xgb_hist(spark, d), KEYS, ["n", "g0", "h0"]), 1)


@query("xgb_histogram", f"WITH {sql.XGB} SELECT party_id, feature_id, x, n, g::DOUBLE AS g, h::DOUBLE AS h FROM hist")
def xgb_histogram(spark, d):
    return xgb_hist(spark, d).withColumnsRenamed({"g0": "g", "h0": "h"})


@query("xgb_gain", f"WITH {sql.XGB} SELECT party_id, feature_id, x, score FROM scored")
def xgb_gain(spark, d):
    return xgb_scored(spark, d).select(*KEYS, "x", "score")


@query("xgb_best_split", f"WITH {sql.XGB} SELECT party_id, feature_id, x, score FROM scored ORDER BY score DESC, party_id, feature_id, x LIMIT 1")
def xgb_best(spark, d):
    return P.best(xgb_scored(spark, d), [], ["party_id", "feature_id", "x"], []).select(*KEYS, "x", "score")


@query("xgb_leaf_weight", f"WITH {sql.LI3} SELECT (quantity <= 25)::INT AS side, round((-sum(0.5 - y2) / (sum(0.25) + 1))::DOUBLE, 9) AS weight FROM li GROUP BY 1")
def xgb_leaf_weight(spark, d):
    by = VF.lineitem(spark, d, "linestatus").data.groupBy((F.col("quantity") <= 25).cast("int").alias("side")).agg(F.sum(0.5 - F.col("y")).alias("g"), F.sum(F.lit(0.25)).alias("h"))
    return by.select("side", F.round(S.leaf_weight(F.col("g"), F.col("h")), 9).alias("weight"))


_RAW = "(CASE WHEN quantity <= 25 THEN 0.4 ELSE -0.3 END + discount)"


def _raw():
    return F.when(F.col("quantity") <= 25, 0.4).otherwise(-0.3) + F.col("discount")


@query("sigmoid", f"WITH {sql.LI3} SELECT DISTINCT quantity, discount, round(1 / (1 + exp(-{_RAW}::DOUBLE)), 9) AS p FROM li")
def sigmoid(spark, d):
    return VF.lineitem(spark, d).data.select("quantity", "discount", F.round(S.sigmoid(_raw()), 9).alias("p")).distinct()


@query("bce_grad_hess", f"WITH {sql.LI3}, p AS (SELECT row_id, y2, 1 / (1 + exp(-{_RAW}::DOUBLE)) AS p FROM li) SELECT row_id, round(p - y2, 9) AS g, round(p * (1 - p), 9) AS h FROM p")
def bce_grad_hess(spark, d):
    p = S.sigmoid(_raw())
    return VF.lineitem(spark, d, "linestatus").data.select("row_id", F.round(S.bce_gradient(F.col("y"), p), 9).alias("g"), F.round(S.bce_hessian(p), 9).alias("h"))


@query("bce_loss", f"WITH {sql.LI3}, p AS (SELECT y2, 1 / (1 + exp(-{_RAW}::DOUBLE)) AS p FROM li) SELECT round(avg(-(y2 * ln(p) + (1 - y2) * ln(1 - p))), 7) AS loss, round(avg(CASE WHEN y2 = 1 THEN ln(1 + exp(-p)) ELSE ln(1 + exp(p)) END), 7) AS double_loss FROM p")
def bce_loss(spark, d):
    df = VF.lineitem(spark, d, "linestatus").data.withColumn("p", S.sigmoid(_raw()))
    return df.agg(F.round(F.avg(S.bce_loss(F.col("y"), F.col("p"))), 7).alias("loss"), F.round(F.avg(S.bce_loss_of_probability(F.col("y"), F.col("p"))), 7).alias("double_loss"))


_SOFT = "e AS (SELECT row_id, y, exp(tax * 10) AS a, exp(discount * 10) AS b, exp(quantity / 25) AS c FROM li), p AS (SELECT row_id, y, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM e)"


def _soft(spark, d):
    probs = S.softmax([F.col("tax") * 10, F.col("discount") * 10, F.col("quantity") / 25])
    return VF.lineitem(spark, d).data.select("row_id", "y", *[p.alias(f"p{k}") for k, p in enumerate(probs)])


@query("softmax", f"WITH {sql.LI3}, {_SOFT} SELECT row_id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM p")
def softmax(spark, d):
    return _soft(spark, d).select("row_id", *[F.round(f"p{k}", 9).alias(f"p{k}") for k in range(3)])


@query("ce_grad_hess", f"WITH {sql.LI3}, {_SOFT} SELECT row_id, round(p0 - (y = 0)::INT, 9) AS g0, round(p1 - (y = 1)::INT, 9) AS g1, round(p2 - (y = 2)::INT, 9) AS g2, round(p0 * (1 - p0), 9) AS h0, round(p1 * (1 - p1), 9) AS h1, round(p2 * (1 - p2), 9) AS h2 FROM p")
def ce_grad_hess(spark, d):
    p = [F.col(f"p{k}") for k in range(3)]
    return _soft(spark, d).select("row_id", *[F.round(x, 9).alias(f"g{k}") for k, x in enumerate(S.ce_gradients(F.col("y"), p))], *[F.round(x, 9).alias(f"h{k}") for k, x in enumerate(S.ce_hessians(p))])


@query("ce_loss", f"WITH {sql.LI3}, {_SOFT} SELECT round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 7) AS loss FROM p")
def ce_loss(spark, d):
    return _soft(spark, d).agg(F.round(F.avg(S.ce_loss(F.col("y"), [F.col(f"p{k}") for k in range(3)])), 7).alias("loss"))


# -- missing values ----------------------------------------------------------------------------------
_EV = (
    "ev AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS x, (event_type = 'click')::INT AS y FROM events), "
    "hist AS (SELECT x, count(*) AS n, sum(y) AS p FROM ev WHERE x IS NOT NULL GROUP BY 1), tot AS (SELECT count(*) AS n, sum(y) AS p, sum((x IS NULL)::INT) AS mn, sum(CASE WHEN x IS NULL THEN y ELSE 0 END) AS mp FROM ev), "
    "run AS (SELECT x, sum(h.n) OVER w AS rn, sum(h.p) OVER w AS rp, tot.n AS tn, tot.p AS tp, mn, mp FROM hist h, tot WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"
)


def _missing(spark, d, left):
    ev = VF.events(spark, d).data.select(F.col("value").alias("x"), (F.col("y") == 0).cast("int").alias("p")).withColumn("k", F.lit(0))
    hist = P.histogram(ev, ["k"], [F.sum("p").alias("p")])
    gone = ev.agg(F.count("*").alias("tn"), F.sum("p").alias("tp"), F.sum(F.col("x").isNull().cast("int")).alias("mn"), F.sum(F.when(F.col("x").isNull(), F.col("p")).otherwise(0)).alias("mp"))
    run = P.cumulative(hist, ["k"], "x", ["n", "p"]).crossJoin(F.broadcast(gone))
    n = F.col("cum_n") + (F.col("mn") if left else 0)
    p = F.col("cum_p") + (F.col("mp") if left else 0)
    return run.where(n < F.col("tn")).select("x", n.alias("left_n"), p.cast("long").alias("left_p"), F.round(S.split_score([n - p, p], [F.col("tn") - F.col("tp"), F.col("tp")]), 9).alias("score"))


def _missing_sql(left):
    n, p = ("rn + mn", "rp + mp") if left else ("rn", "rp")
    g = lambda a, b: f"coalesce({sql.gini(a, f'({a}) - ({b})', b)}, 0)"
    return (
        f"WITH {_EV}, z AS (SELECT x, ({n})::BIGINT AS left_n, ({p})::BIGINT AS left_p, tn, tp FROM run) SELECT x, left_n, left_p, "
        f"round({g('tn', 'tp')} - left_n::DOUBLE / tn * {g('left_n', 'left_p')} - (1 - left_n::DOUBLE / tn) * {g('(tn - left_n)', 'tp - left_p')}, 9) AS score FROM z WHERE left_n < tn"
    )


query("missing_right_split", _missing_sql(False))(lambda spark, d: _missing(spark, d, False))
query("missing_left_split", _missing_sql(True))(lambda spark, d: _missing(spark, d, True))
