"""Queries of preparation: encode, scale, sample, split, allocate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove import frame as VF
from veilgrove.catalogue import query
from veilgrove.operators import prep as P
from veilgrove.queries import sql


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("label_encode", "SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def label_encode(spark, d):
    return P.label_encode(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "code")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("onehot_drop_first", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in SEGMENTS[1:]) + " FROM customer")
def onehot(spark, d):
    got = P.one_hot(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return got.select("c_custkey", *[c if c in got.columns else F.lit(0).alias(c) for c in (f"c_mktsegment_{s}" for s in SEGMENTS[1:])])


@query("minmax_scale", f"WITH {sql.LI3}, m AS (SELECT min(quantity) a, max(quantity) b, min(tax) c, max(tax) d FROM li) SELECT row_id, round((quantity - a) / (b - a), 9) AS quantity, round((tax - c) / (d - c), 9) AS tax FROM li, m")
def minmax(spark, d):
    got = P.min_max(VF.lineitem(spark, d).data.select("row_id", "quantity", "tax"), ["quantity", "tax"])
    return got.select("row_id", F.round("quantity", 9).alias("quantity"), F.round("tax", 9).alias("tax"))


@query("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status FROM orders")
def value_map(spark, d):
    return t(spark, d, "orders").select("o_orderkey", P.map_values(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2}).alias("status"))


@query("decimal_comma_parse", "SELECT c_custkey, c_acctbal AS value FROM customer")
def decimal_comma(spark, d):
    text = F.regexp_replace(F.col("c_acctbal").cast("string"), "[.]", ",")
    return t(spark, d, "customer").select("c_custkey", P.decimal_comma(text).alias("value"))


@query("leading_int", "SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::INT AS year FROM orders")
def leading_int(spark, d):
    return t(spark, d, "orders").select("o_orderkey", P.leading_int(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query("drop_duplicates", "SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem")
def drop_duplicates(spark, d):
    return t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax").dropDuplicates()


@query("concat_union", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_union(spark, d):
    return t(spark, d, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v").unionByName(t(spark, d, "supplier").selectExpr("s_acctbal AS v", "s_suppkey AS k"))


@query("filter_by_label", "SELECT doc_id FROM labels WHERE quality = 1")
def filter_by_label(spark, d):
    return t(spark, d, "labels").where("quality = 1").select("doc_id")


@query("shift_and_project", "SELECT event_id, user_id - 1 AS user_index FROM events")
def shift(spark, d):
    return t(spark, d, "events").drop("props").select("event_id", (F.col("user_id") - 1).alias("user_index"))


@query("nan_fill", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE value END AS value FROM events")
def nan_fill(spark, d):
    return VF.events(spark, d).data.select(F.col("row_id").alias("event_id"), F.coalesce("value", F.lit(-1.0)).alias("value"))


_ORDER = "(doc_id * 7919 + 3) % 1000, doc_id"


@query("balanced_sample", f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}) AS r FROM labels) WHERE r <= 8")
def balanced(spark, d):
    return P.balanced_sample(t(spark, d, "labels").select("doc_id", "quality"), "quality", 16, [P.spread(F.col("doc_id"), 3), F.col("doc_id")])


@query("uniform_sample", f"SELECT doc_id FROM labels ORDER BY {_ORDER} LIMIT 50")
def uniform(spark, d):
    return P.uniform_sample(t(spark, d, "labels").select("doc_id"), 50, [P.spread(F.col("doc_id"), 3), F.col("doc_id")])


@query("stratified_split", f"SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}) <= floor(0.2 * count(*) OVER (PARTITION BY quality)) AS is_val FROM labels")
def stratified(spark, d):
    return P.stratified_split(t(spark, d, "labels"), "quality", [P.spread(F.col("doc_id"), 3), F.col("doc_id")]).select("doc_id", "is_val")


@query("row_subsample", f"WITH {sql.LI3}, n AS (SELECT floor(count(*) * 0.8)::BIGINT AS n FROM li) SELECT tree::INT AS tree, n FROM n, range(3) t(tree)")
def row_subsample(spark, d):
    """Rows that each of three trees is grown on."""
    from veilgrove.plans import grow as G

    m = G.fit_forest(VF.lineitem(spark, d), G.Params(trees=3, depth=0, row_ratio=0.8))
    return spark.createDataFrame([(x.tree, x.n) for x in m.nodes.values()], "tree int, n long")


@query("column_subsample", "SELECT f AS feature_id, (f >= 32)::INT AS party_id FROM (SELECT f, row_number() OVER (PARTITION BY f >= 32 ORDER BY ((f + 1)::HUGEINT * 2654435761 + 7 * 40503) % 4294967296) AS r FROM range(64) t(f)) WHERE r <= 25")
def column_subsample(spark, d):
    from veilgrove.plans import grow as G

    got = G.sampled_features(VF.embeddings(spark, d).features, G.Params(col_ratio=0.8, seed=5), 2)
    return spark.createDataFrame([(f.feature_id, f.party_id) for f in got], "feature_id long, party_id int")


@query("column_alloc", "SELECT f AS feature_id, (r > 19)::INT AS party_id FROM (SELECT f, row_number() OVER (ORDER BY (f * 7919 + 1) % 1000, f) AS r FROM range(64) t(f))")
def column_alloc(spark, d):
    parties = P.allocate_columns(list(range(64)), 0.3, seed=1)
    return spark.createDataFrame([(f, p) for p, own in enumerate(parties) for f in own], "feature_id long, party_id int")


@query("contiguous_alloc", "SELECT f AS feature_id, (f >= 32)::INT AS party_id FROM range(64) t(f)")
def contiguous(spark, d):
    return spark.createDataFrame([(f.feature_id, f.party_id) for f in VF.embeddings(spark, d).features], "feature_id long, party_id int")


_MI = (
    f"WITH {sql.LI3}, b AS (SELECT y, 'discount' AS feature, round(discount * 100)::BIGINT AS bin FROM li UNION ALL SELECT y, 'quantity', floor(quantity / 10)::BIGINT FROM li UNION ALL SELECT y, 'tax', round(tax * 100)::BIGINT FROM li), "
    "j AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY feature) t, sum(n) OVER (PARTITION BY feature, bin) nb, sum(n) OVER (PARTITION BY feature, y) ny FROM j) "
)


@query("mutual_info", _MI + "SELECT feature, round(sum(n / t::DOUBLE * ln(n * t / (nb * ny)::DOUBLE)), 9) AS score FROM k GROUP BY feature")
def mutual_info(spark, d):
    bins = {"discount": F.round(F.col("discount") * 100), "quantity": F.floor(F.col("quantity") / 10), "tax": F.round(F.col("tax") * 100)}
    return P.mutual_information(VF.lineitem(spark, d).data, "y", bins).select("feature", F.round("score", 9).alias("score"))


@query("importance_alloc", _MI + ", s AS (SELECT feature, sum(n / t::DOUBLE * ln(n * t / (nb * ny)::DOUBLE)) AS v FROM k GROUP BY feature) SELECT feature, (row_number() OVER (ORDER BY v, feature) > 1)::INT AS party_id FROM s")
def importance(spark, d):
    names = sorted(("discount", "quantity", "tax"))
    scores = {r.feature: r.score for r in mutual_info(spark, d).collect()}
    active, passive = P.allocate_by_importance({k: scores[n] for k, n in enumerate(names)}, 1)
    return spark.createDataFrame([(names[f], p) for p, own in enumerate((active, passive)) for f in own], "feature string, party_id int")


@query("even_split", "SELECT w AS worker, (8 / 3)::INT * 0 + CASE WHEN w < 8 % 3 THEN 3 ELSE 2 END AS jobs FROM range(3) t(w)")
def even_split(spark, d):
    return spark.createDataFrame(list(enumerate(P.even_split(3, 8))), "worker long, jobs int")


@query("frame_cells", f"WITH {sql.CELLS} SELECT party_id, feature_id, count(*) AS n, round(sum(x), 2) AS total FROM cells GROUP BY ALL")
def frame_cells(spark, d):
    return VF.lineitem(spark, d).cells().groupBy("party_id", "feature_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
