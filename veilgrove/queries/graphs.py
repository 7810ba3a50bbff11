"""Queries of leaf graphs, components, communities, and metrics of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove import frame as VF
from veilgrove.catalogue import query
from veilgrove.operators import graph as G
from veilgrove.operators import metrics as M
from veilgrove.queries import sql
from veilgrove.storage import cut


def groups(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label, leaf: vectors in buckets of their first two dimensions."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    bucket = lambda k: F.floor(F.col("embedding")[k] * 4).cast("int")
    return e.select(F.col("vec_id").alias("row_id"), "label", (bucket(0) * 1000 + bucket(1)).alias("leaf"))


def edges(spark, d):
    return G.clique_edges(groups(spark, d), ["leaf"])


def comm(spark, d):
    return groups(spark, d).select(F.col("row_id").alias("node"), F.col("label").alias("comm"))


@query("leaf_clique_edges", f"WITH {sql.EDGES} SELECT src, dst, w FROM e")
def leaf_clique_edges(spark, d):
    return edges(spark, d)


@query("chunked_clique", f"WITH {sql.GROUPS}, c AS (SELECT row_id, leaf, floor((row_number() OVER (PARTITION BY leaf ORDER BY row_id) - 1) / 3)::INT AS chunk FROM g), l AS (SELECT leaf, chunk, min(row_id) AS lo, max(row_id) AS hi FROM c GROUP BY ALL) "
       "SELECT a.row_id AS src, b.row_id AS dst FROM c a JOIN c b ON a.leaf = b.leaf AND a.chunk = b.chunk AND a.row_id > b.row_id UNION SELECT greatest(x.hi, y.lo), least(x.hi, y.lo) FROM l x JOIN l y ON x.leaf = y.leaf AND y.chunk = x.chunk + 1")
def chunked_clique(spark, d):
    cut_up, links = G.chunked(groups(spark, d).select("row_id", "leaf"), ["leaf"], 3)
    return G.clique_edges(cut_up, ["leaf", "chunk"]).select("src", "dst").union(links).distinct()


_TWO = sql.EDGES + ", f AS (SELECT a.row_id AS src, b.row_id AS dst, 0.3::DOUBLE AS w FROM g a JOIN g b ON a.label = b.label AND a.leaf % 7 = b.leaf % 7 AND a.row_id > b.row_id)"


def two_trees(spark, d):
    g = groups(spark, d).withColumn("k", F.col("leaf") % 7)
    return G.add_edges(edges(spark, d), G.clique_edges(g, ["label", "k"], weight=0.3))


@query("adjacency_sum", f"WITH {_TWO} SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY ALL")
def adjacency_sum(spark, d):
    return two_trees(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


@query("sparse_add_cancels", f"WITH {sql.EDGES} SELECT src, dst, w FROM e WHERE src % 3 <> 0")
def sparse_add(spark, d):
    e = edges(spark, d)
    return G.add_edges(e, e.where("src % 3 = 0").withColumn("w", -F.col("w")))


@query("pair_key", f"WITH {sql.EDGES} SELECT src, dst, CASE WHEN src >= dst THEN src * src + src + dst ELSE dst * dst + src END AS k FROM e")
def pair_key(spark, d):
    from veilgrove.functions.scalar import pair_key as key

    return edges(spark, d).select("src", "dst", key(F.col("src"), F.col("dst")).alias("k"))


@query("nonisolated_ratio", f"WITH {sql.EDGES} SELECT round((SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) / (SELECT count(*) FROM g)::DOUBLE, 9) AS ratio")
def nonisolated(spark, d):
    return G.non_isolated(edges(spark, d), groups(spark, d)).select(F.round("ratio", 9).alias("ratio"))


@query("union_star_edges", f"WITH {sql.GROUPS}, m AS (SELECT leaf, min(row_id) AS dst FROM g GROUP BY 1) SELECT row_id AS src, dst FROM g JOIN m USING (leaf) WHERE row_id <> dst")
def union_star(spark, d):
    return G.star_edges(groups(spark, d), ["leaf"])


_UNION = (
    f"WITH RECURSIVE {sql.GROUPS}, m AS (SELECT leaf, min(row_id) AS a FROM g GROUP BY 1), v AS (SELECT row_id, label * 100 + leaf % 5 AS k FROM g), m2 AS (SELECT k, min(row_id) AS a FROM v GROUP BY 1), "
    "e AS (SELECT row_id AS x, a AS y FROM g JOIN m USING (leaf) UNION SELECT row_id, a FROM v JOIN m2 USING (k)), s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), "
    "r(row_id, root) AS (SELECT row_id, row_id FROM g UNION SELECT s.y, r.root FROM r JOIN s ON s.x = r.row_id WHERE r.root <= s.y) SELECT row_id, min(root) AS root FROM r GROUP BY 1"
)


@query("union_components", _UNION)
def union_components(spark, d):
    g = groups(spark, d)
    second = g.withColumn("k", F.col("label") * 100 + F.col("leaf") % 5)
    stars = G.star_edges(g, ["leaf"]).union(G.star_edges(second, ["k"]))
    return G.components(stars, cut, g)


@query("weighted_degree", f"WITH {sql.BOTH} SELECT src AS node, sum(w) AS k FROM s GROUP BY 1")
def weighted_degree(spark, d):
    return G.degrees(edges(spark, d))


@query("self_loops", f"WITH {sql.BOTH} SELECT x.comm AS node, 2.0 * count(*)::DOUBLE AS w FROM e JOIN comm x ON x.node = e.src JOIN comm y ON y.node = e.dst WHERE x.comm = y.comm GROUP BY 1")
def self_loops(spark, d):
    return G.self_loops(G.contract(edges(spark, d), comm(spark, d)))


@query("modularity", f"WITH {sql.BOTH}, p AS (SELECT s.w, x.comm AS c1, y.comm AS c2 FROM s JOIN comm x ON x.node = s.src JOIN comm y ON y.node = s.dst), c AS (SELECT c1, sum(w) AS tot, sum(CASE WHEN c1 = c2 THEN w ELSE 0 END) AS i FROM p GROUP BY 1), m AS (SELECT sum(tot) AS m FROM c) SELECT round(sum(i / m - tot / m * (tot / m)), 9) AS q FROM c, m")
def modularity(spark, d):
    return G.modularity(edges(spark, d), comm(spark, d)).select(F.round("q", 9).alias("q"))


@query("neighbour_comms", f"WITH {sql.BOTH} SELECT s.src AS node, c.comm, sum(w) AS w FROM s JOIN comm c ON c.node = s.dst GROUP BY ALL")
def neighbour_comms(spark, d):
    return G.neighbour_weights(edges(spark, d), comm(spark, d))


_GAIN = (
    f"WITH {sql.BOTH}, k AS (SELECT src AS node, sum(w) AS k FROM s GROUP BY 1), m AS (SELECT sum(k) AS m FROM k), own AS (SELECT c.node, c.comm AS own, coalesce(k, 0) AS k FROM comm c LEFT JOIN k USING (node)), tot AS (SELECT own AS comm, sum(k) AS tot FROM own GROUP BY 1), "
    "o AS (SELECT node, comm, sum(w) AS w FROM (SELECT s.src AS node, c.comm, w FROM s JOIN comm c ON c.node = s.dst UNION ALL SELECT node, own, 0 FROM own) GROUP BY ALL) "
    "SELECT o.node, own.own, o.comm, round(o.w - (tot.tot - CASE WHEN o.comm = own.own THEN k ELSE 0 END) * k / m, 6) AS gain FROM o JOIN own USING (node) JOIN tot ON tot.comm = o.comm, m"
)


@query("modularity_gain", _GAIN)
def modularity_gain(spark, d):
    return G.gains(edges(spark, d), comm(spark, d)).select("node", "own", "comm", F.round("gain", 6).alias("gain"))


@query("contraction", f"WITH {sql.BOTH} SELECT greatest(x.comm, y.comm) AS src, least(x.comm, y.comm) AS dst, sum(CASE WHEN x.comm = y.comm THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM e JOIN comm x ON x.node = e.src JOIN comm y ON y.node = e.dst GROUP BY ALL")
def contraction(spark, d):
    return G.contract(edges(spark, d), comm(spark, d))


@query("louvain_one_pass")
def louvain_one_pass(spark, d):
    e = cut(edges(spark, d))
    start = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("comm"))
    return G.move(e, start, 0)


@query("louvain")
def louvain(spark, d):
    return G.louvain(edges(spark, d), cut)


# -- clusterings -----------------------------------------------------------------------------------
_T = sql.GROUPS + ", t AS (SELECT label, leaf, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY label)::DOUBLE AS a, sum(n) OVER (PARTITION BY leaf)::DOUBLE AS b, sum(n) OVER ()::DOUBLE AS t FROM t)"
_R = ", r AS (SELECT label, max(a) AS a, max(t) AS t, max(n) AS m, max(2.0 * n / (a + b)) AS f FROM b GROUP BY 1), k AS (SELECT leaf, max(b) AS b, max(t) AS t, max(n) AS m FROM b GROUP BY 1)"
_H = "(SELECT sum(-n / t * ln(n / b)) FROM b)", "(SELECT sum(-a / t * ln(a / t)) FROM r)", "(SELECT sum(-n / t * ln(n / a)) FROM b)", "(SELECT sum(-b / t * ln(b / t)) FROM k)"
_HOM, _COM = f"(1 - {_H[0]} / {_H[1]})", f"(1 - {_H[2]} / {_H[3]})"
_SQL = {
    "homogeneity": _HOM, "completeness": _COM, "v_measure": f"(2 * {_HOM} * {_COM} / ({_HOM} + {_COM}))", "purity": "(SELECT sum(m / t) FROM k)", "inverse_purity": "(SELECT sum(m / t) FROM r)", "f_measure": "(SELECT sum(f * a / t) FROM r)",
    "fowlkes_mallows": "((SELECT (sum(n * n) - max(t)) FROM b)::DOUBLE / (sqrt((SELECT sum(a * a) - max(t) FROM r)) * sqrt((SELECT sum(b * b) - max(t) FROM k))))",
}


@query("contingency", f"WITH {_T} SELECT label, leaf, n FROM t")
def contingency(spark, d):
    return M.contingency(groups(spark, d), "label", "leaf")


def _score(name):
    def run(spark, d):
        return M.cluster_scores(M.contingency(groups(spark, d), "label", "leaf"), "label", "leaf").select(F.round(name, 9).alias(name))

    query(name, f"WITH {_T}{_R} SELECT round({_SQL[name]}, 9) AS {name}")(run)


for _name in _SQL:
    _score(_name)


# -- predictions --------------------------------------------------------------------------------------
_AUC = "CASE WHEN sum(p) * sum(q) = 0 THEN NULL ELSE sum(p * (2 * below + q)) / (2.0 * sum(p) * sum(q)) END"


@query("roc_auc", f"WITH {sql.LI3}, h AS (SELECT quantity AS s, sum(y2) AS p, sum(1 - y2) AS q FROM li GROUP BY 1), r AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h) SELECT round(({_AUC})::DOUBLE, 9) AS auc FROM r")
def roc_auc(spark, d):
    df = VF.lineitem(spark, d, "linestatus").data
    return M.auc(df, "quantity", F.col("y") == 1).select(F.round("auc", 9).alias("auc"))


@query("ovr_auc", f"WITH {sql.LI3}, c AS (SELECT 0 AS k, quantity AS s, (y = 0)::INT AS y FROM li UNION ALL SELECT 1, discount, (y = 1)::INT FROM li UNION ALL SELECT 2, tax, (y = 2)::INT FROM li), h AS (SELECT k, s, sum(y) AS p, sum(1 - y) AS q FROM c GROUP BY ALL), "
       f"r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h), a AS (SELECT k, ({_AUC})::DOUBLE AS auc FROM r GROUP BY 1) SELECT round(avg(auc), 9) AS auc FROM a")
def ovr_auc(spark, d):
    return M.ovr_auc(VF.lineitem(spark, d).data, ["quantity", "discount", "tax"], "y").select(F.round("auc", 9).alias("auc"))


@query("trapezoid", f"WITH {sql.LI3}, h AS (SELECT quantity AS x, avg(y2) AS v FROM li GROUP BY 1), s AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (v + lag(v) OVER (ORDER BY x)) / 2 AS a FROM h) SELECT round(sum(a), 7) AS area FROM s")
def trapezoid(spark, d):
    h = VF.lineitem(spark, d, "linestatus").data.groupBy(F.col("quantity").alias("x")).agg(F.avg("y").alias("v"))
    return M.trapezoid(h, "x", "v", "x").select(F.round("area", 7).alias("area"))


@query("leaf_purity", f"WITH {sql.LI3}, c AS (SELECT quantity <= 25 AS a, discount <= 0.05 AS b, y, count(*) AS n FROM li GROUP BY ALL), m AS (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY a, b) SELECT round(sum(m) / sum(n)::DOUBLE, 9) AS purity FROM m")
def leaf_purity(spark, d):
    df = VF.lineitem(spark, d).data.withColumns({"a": F.col("quantity") <= 25, "b": F.col("discount") <= 0.05})
    return M.purity(df, "y", ["a", "b"]).select(F.round("purity", 9).alias("purity"))


@query("report_mean_std", "SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_pop(l_quantity), 4) AS l_quantity_pop, round(stddev_samp(l_quantity), 4) AS l_quantity_samp FROM lineitem GROUP BY 1")
def report_mean_std(spark, d):
    return M.mean_std(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], ["l_quantity"])


@query("ciphertext_count", f"WITH {sql.CUM}, k AS (SELECT count(*) AS k FROM run WHERE party_id = 1 AND tot_n > cum_n), n AS (SELECT count(*) AS n FROM li) SELECT (k * 9 + n * 2 * 4 * 3)::BIGINT AS boosting, (k * 3 + n * 3)::BIGINT AS forest FROM k, n")
def ciphertext_count(spark, d):
    from veilgrove.queries.splits import COLS, KEYS, hist3
    from veilgrove.operators import split as P

    k = P.candidates(hist3(spark, d), KEYS, COLS).where("party_id = 1").count()
    n = VF.lineitem(spark, d).data.count()
    return spark.createDataFrame([(M.ciphertexts(k, n, 3, 5, 1, True, True), M.ciphertexts(k, n, 3, 5, 0, False, False))], "boosting long, forest long")
