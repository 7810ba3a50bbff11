"""Queries of text formats and of whole runs: attack and defence."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrove import frame as VF
from veilgrove.catalogue import query
from veilgrove.operators import graph as R
from veilgrove.plans import attack as A
from veilgrove.plans import defend as D
from veilgrove.plans import grow as G
from veilgrove.queries import sql
from veilgrove.queries.graphs import edges, groups
from veilgrove.sources import codec as C
from veilgrove.storage import cut


@query("adjacency_roundtrip", f"WITH {sql.EDGES} SELECT src, dst, w FROM e")
def adjacency_roundtrip(spark, d):
    nodes = groups(spark, d).select(F.col("row_id").alias("node"))
    return C.adjacency_edges(C.adjacency_lines(edges(spark, d), nodes))


@query("community_roundtrip", f"WITH {sql.GROUPS} SELECT row_id AS node, label::BIGINT AS comm FROM g")
def community_roundtrip(spark, d):
    comm = groups(spark, d).select(F.col("row_id").alias("node"), F.col("label").cast("long").alias("comm"))
    return C.community_rows(C.community_lines(comm))


@query("union_roundtrip", "SELECT row_id, min(row_id) OVER (PARTITION BY leaf) AS root FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, floor(embedding[1] * 4)::INT * 1000 + floor(embedding[2] * 4)::INT AS leaf FROM embeddings)")
def union_roundtrip(spark, d):
    ids = {r.row_id: k for k, r in enumerate(groups(spark, d).select("row_id").orderBy("row_id").collect())}
    g = groups(spark, d).join(spark.createDataFrame(list(ids.items()), "row_id long, k long"), "row_id").select(F.col("k").alias("row_id"), "leaf")
    return C.union_rows(C.union_line(R.components(R.star_edges(g, ["leaf"]), cut, g)))


@query("dense_roundtrip", f"WITH {sql.EDGES} SELECT src, dst, w FROM e")
def dense_roundtrip(spark, d):
    e = edges(spark, d)
    n = groups(spark, d).agg(F.max("row_id")).first()[0] + 1
    return R.from_dense(R.to_dense(e, n))


@query("compressed_source", f"WITH {sql.EDGES} SELECT src, dst, w FROM e")
def compressed_source(spark, d):
    """Edges from compressed rows of the whole symmetric matrix."""
    rows = R.symmetric(edges(spark, d)).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("v"))
    return R.from_compressed(rows.select("node", F.transform("v", lambda x: x["dst"]).alias("columns"), F.transform("v", lambda x: x["w"]).alias("values")))


@query("log_extract", "SELECT event_id::INT AS round, value FROM events")
def log_extract(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return C.log_values(ev.select(F.format_string("round %d: train loss: %s", F.col("event_id"), F.col("value").cast("string")).alias("value")), "loss")


@query("in_codec_roundtrip", "SELECT doc_id AS row_id, quality::INT AS y, n_chars::DOUBLE AS f0, (lang = 'en')::INT::DOUBLE AS f1 FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL")
def in_codec(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality IS NOT NULL")
    vf = VF.frame(docs, F.col("doc_id"), F.col("quality"), [[("n_chars", F.col("n_chars"))], [("english", (F.col("lang") == "en").cast("int"))]], 2)
    back, _ = C.from_text(spark, C.to_text(vf, vf))
    ids = spark.createDataFrame(list(enumerate(r.row_id for r in vf.data.select("row_id").orderBy("row_id").collect())), "row_id long, id long")
    return back.data.join(ids, "row_id").select(F.col("id").alias("row_id"), "y", "f0", "f1")


@query("nan_sentinel", "SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value END::DOUBLE AS x FROM events")
def nan_sentinel(spark, d):
    return VF.events(spark, d).party(0).cells().select("row_id", F.coalesce("x", F.lit(-1.0)).alias("x"))


# -- runs -----------------------------------------------------------------------------------------------
def _small(spark, d):
    return VF.embeddings(spark, d)


@query("forest_adjacency")
def forest_adjacency(spark, d):
    vf = _small(spark, d)
    return A.adjacency(vf, G.fit_forest(vf, G.Params(trees=2, depth=3, bins=32)), chunk=50)


@query("union_attack")
def union_attack(spark, d):
    vf = _small(spark, d)
    return A.union_attack(vf, G.fit_forest(vf, G.Params(trees=1, depth=3, bins=32)), cut)


@query("lpmst_fit")
def lpmst_fit(spark, d):
    from veilgrove.queries.models import nodes_frame

    model, _ = D.staged_noise(_small(spark, d), G.Params(trees=1, depth=2, bins=16), 1.0, cut)
    return nodes_frame(spark, model)


@query("self_repair")
def self_repair(spark, d):
    from veilgrove.queries.models import nodes_frame

    vf = _small(spark, d)
    flipped = vf.data.select("row_id", F.when(F.col("e0") > 0, (F.col("y") + 1) % 10).otherwise(F.col("y")).alias("z"))
    bad = vf._replace(data=vf.data.drop("y").join(flipped.withColumnRenamed("z", "y"), "row_id"))
    return nodes_frame(spark, D.repair(vf, G.fit_forest(bad, G.Params(trees=1, depth=2, bins=16)), flipped))


@query("implicit_clique_degree", f"WITH {sql.GROUPS} SELECT row_id AS node, (count(*) OVER (PARTITION BY leaf) - 1)::DOUBLE AS k FROM g")
def implicit_degree(spark, d):
    return R.clique_degrees(groups(spark, d), ["leaf"])


# -- what leaves show -------------------------------------------------------------------------------------
def _hidden_model(frame):
    """The fixed tree with its right split by the label owner, so that other parties do not see its leaves apart."""
    from veilgrove.queries.models import fixed_model

    m = fixed_model(frame)
    m.nodes[0, 3].feature, m.nodes[0, 3].party, m.nodes[0, 3].threshold = 1, 0, 30000.0
    G.mark_hidden(m)
    return m


_SEEN = "CASE WHEN quantity <= 25 THEN {left} ELSE {right} END"
_LEFT, _RIGHT = "CASE WHEN discount <= 0.05 THEN 4 ELSE 5 END", "CASE WHEN extendedprice <= 30000 THEN 6 ELSE 7 END"


def _seen(name: str, left: str, right: str, **kw: bool) -> None:
    def run(spark, d):
        from veilgrove.queries.models import lineitem2

        vf = lineitem2(spark, d)
        return A.groups(vf, _hidden_model(vf), **kw).groupBy("grp").agg(F.count("*").alias("n"))

    query(name, f"WITH {sql.LI3} SELECT {_SEEN.format(left=left, right=right)} AS grp, count(*) AS n FROM li GROUP BY 1")(run)


_seen("visible_leaves", _LEFT, "3")
_seen("freerider_groups", "2", "3", free_rider=True)
_seen("observer_leaves", _LEFT, _RIGHT, target=False)


@query("singleton_ratio", f"WITH {sql.LI3}, s AS (SELECT {_SEEN.format(left=_LEFT, right='3')} AS grp, count(*) AS n FROM li GROUP BY 1) SELECT round(avg((n = 1)::INT), 9) AS ratio FROM s")
def singleton_ratio(spark, d):
    from veilgrove.queries.models import lineitem2

    vf = lineitem2(spark, d)
    return A.singleton_ratio(vf, _hidden_model(vf)).select(F.round("ratio", 9).alias("ratio"))


@query("components_of_groups", f"WITH {sql.GROUPS} SELECT row_id, min(row_id) OVER (PARTITION BY leaf) AS root FROM g")
def components_of_groups(spark, d):
    g = groups(spark, d)
    return R.components(R.star_edges(g, ["leaf"]), cut, g)
