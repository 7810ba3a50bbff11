"""Leaf co-membership graphs: edges, components, modularity, communities.

Edges are ``src > dst`` with a weight.  A clique of s rows has s(s-1)/2 edges, so
nothing here expands one unless edges are asked for: components come from stars,
and community search works on the (group, row) table, in which the weight
between a row and a community is a sum over the groups they share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clique_edges(groups: DataFrame, group: list[str], row: str = "row_id", weight: Column | float = 1.0) -> DataFrame:
    """src, dst, w of all pairs of rows in a group, added up over groups."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    g = groups.withColumn("_w", w)
    a, b = g.alias("a"), g.select(*group, row).alias("b")
    pairs = a.join(b, group).where(F.col(f"a.{row}") > F.col(f"b.{row}"))
    return pairs.groupBy(F.col(f"a.{row}").alias("src"), F.col(f"b.{row}").alias("dst")).agg(F.sum("_w").alias("w"))


def chunked(groups: DataFrame, group: list[str], size: int, row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Groups cut into chunks of ``size`` in order of rows, and the links from a chunk's last row to the next one's first."""
    w = W.partitionBy(*group).orderBy(row)
    cut = groups.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    ends = cut.groupBy(*group, "chunk").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    nxt = ends.select(*group, (F.col("chunk") - 1).alias("chunk"), F.col("lo").alias("next"))
    links = ends.join(nxt, [*group, "chunk"]).select(F.greatest("hi", "next").alias("src"), F.least("hi", "next").alias("dst"))
    return cut, links


def add_edges(*parts: DataFrame) -> DataFrame:
    """Sum of edge lists; edges whose weights cancel are gone."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w")).where(F.col("w") != 0)


def from_dense(rows: DataFrame) -> DataFrame:
    """src, dst, w of the lower triangle of a symmetric matrix given by rows: node (from 0), values."""
    cells = rows.select(F.col("node").alias("src"), F.posexplode("values").alias("dst", "w"))
    return cells.where((F.col("w") != 0) & (F.col("dst") <= F.col("src"))).select("src", F.col("dst").cast("long").alias("dst"), "w")


def to_dense(edges: DataFrame, n: int) -> DataFrame:
    """node, values: the rows of the symmetric matrix of ``n`` nodes; each row is an array, so this is for small graphs."""
    own = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("m"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    at = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return nodes.join(own, "node", "left").select("node", F.transform(at, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values"))


def from_compressed(rows: DataFrame) -> DataFrame:
    """src, dst, w of the lower triangle from compressed rows: node, columns, values."""
    cells = rows.select(F.col("node").alias("src"), F.explode(F.arrays_zip("columns", "values")).alias("c")).select("src", F.col("c.columns").cast("long").alias("dst"), F.col("c.values").alias("w"))
    return cells.where((F.col("dst") <= F.col("src")) & (F.col("w") != 0))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, loops once."""
    return edges.select("src", "dst", "w").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, k: sum of stored weights over both directions."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))


def clique_degrees(groups: DataFrame, group: list[str], row: str = "row_id") -> DataFrame:
    """node, k: degrees in the graph of cliques without its edges: group sizes less one."""
    size = groups.groupBy(*group).agg(F.count("*").alias("_n"))
    return groups.join(size, group).groupBy(F.col(row).alias("node")).agg(F.sum(F.col("_n") - 1).cast("double").alias("k"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("w"))


def non_isolated(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """ratio: share of the rows that an edge touches."""
    touched = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("t"))
    return touched.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select((F.col("t") / F.col("n")).alias("ratio"))


def star_edges(groups: DataFrame, group: list[str], row: str = "row_id") -> DataFrame:
    """src, dst: each row of a group with the group's smallest row."""
    low = groups.groupBy(*group).agg(F.min(row).alias("dst"))
    return groups.join(low, group).where(F.col(row) != F.col("dst")).select(F.col(row).alias("src"), "dst").distinct()


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """row_id, root: the smallest row of each row's component, by large-star and small-star rounds."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    star = e.select(F.col("a").alias("row_id"), F.col("b").alias("root"))
    if rows is None:
        return star
    return rows.select("row_id").join(star, "row_id", "left").select("row_id", F.coalesce("root", "row_id").alias("root"))


# -- communities ---------------------------------------------------------------------------------
def modularity(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """q of a partition (node, comm): sum over communities of in/m - (tot/m)^2, m the stored weight of both directions."""
    both = symmetric(edges)
    c1, c2 = comm.select(F.col("node").alias("src"), F.col("comm").alias("c1")), comm.select(F.col("node").alias("dst"), F.col("comm").alias("c2"))
    placed = both.join(c1, "src").join(c2, "dst")
    by = placed.groupBy("c1").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"))
    m = by.agg(F.sum("tot").alias("m"))
    part = F.col("inside") / F.col("m") - F.col("tot") / F.col("m") * (F.col("tot") / F.col("m"))
    return by.crossJoin(F.broadcast(m)).agg(F.sum(part).alias("q"))


def neighbour_weights(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """node, comm, w: weight from a node to each neighbouring community, itself left out."""
    to = comm.select(F.col("node").alias("dst"), "comm")
    return symmetric(edges).where("src <> dst").join(to, "dst").groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("w"))


def gains(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """node, own, comm, gain: w(node, comm) - tot(comm without the node) * k / m for its own and every neighbouring community."""
    k = degrees(edges)
    m = k.agg(F.sum("k").alias("m"))
    placed = comm.join(k, "node", "left").fillna(0.0, ["k"])
    tot = placed.groupBy("comm").agg(F.sum("k").alias("tot"))
    own = placed.select("node", F.col("comm").alias("own"), "k")
    near = neighbour_weights(edges, comm)
    options = near.unionByName(own.select("node", F.col("own").alias("comm"), F.lit(0.0).alias("w"))).groupBy("node", "comm").agg(F.sum("w").alias("w"))
    x = options.join(own, "node").join(tot, "comm").crossJoin(F.broadcast(m))
    rest = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0.0)
    return x.select("node", "own", "comm", (F.col("w") - rest * F.col("k") / F.col("m")).alias("gain"))


def move(edges: DataFrame, comm: DataFrame, sweep: int, parity: bool = True) -> DataFrame:
    """node, comm after one synchronous sweep: a node goes where it gains most, ties to the smallest community.

    Only nodes of one parity of a hash move at a time, since neighbours that
    swap places at once would do so for ever.
    """
    g = gains(edges, comm)
    best = g.groupBy("node", "own").agg(F.min(F.struct(-F.round("gain", 9), "comm")).alias("b"), F.max(F.when(F.col("comm") == F.col("own"), F.round("gain", 9))).alias("stay"))
    free = F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(2)) == 0 if parity else F.lit(True)
    goes = free & (-F.col("b")[best.schema["b"].dataType.names[0]] > F.col("stay"))
    moved = best.select("node", F.when(goes, F.col("b.comm")).otherwise(F.col("own")).alias("comm"))
    return comm.select("node").join(moved, "node", "left").join(comm.withColumnRenamed("comm", "_was"), "node").select("node", F.coalesce("comm", "_was").alias("comm"))


def contract(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """Edges between communities; weights inside one become its loop, both directions of an edge counting."""
    c1, c2 = comm.select(F.col("node").alias("src"), F.col("comm").alias("c1")), comm.select(F.col("node").alias("dst"), F.col("comm").alias("c2"))
    e = edges.join(c1, "src").join(c2, "dst")
    w = F.when((F.col("c1") == F.col("c2")) & (F.col("src") != F.col("dst")), 2 * F.col("w")).otherwise(F.col("w"))
    return e.groupBy(F.greatest("c1", "c2").alias("src"), F.least("c1", "c2").alias("dst")).agg(F.sum(w).alias("w"))


#: Edges up to which a level's local moves run in order on the driver: a bound on what it holds.
LOCAL_EDGES = 200_000


def move_in_order(edges: list[tuple[int, int, float]], start: dict[int, int] | None = None, tolerance: float = 1e-12) -> dict[int, int]:
    """node -> community: nodes in order each go where they gain most, ties to the smallest community, until none moves."""
    near: dict[int, dict[int, float]] = {}
    k: dict[int, float] = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
            near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0.0) + w
            k[x] = k.get(x, 0.0) + w
    total = sum(k.values())
    comm = dict(start) if start else {x: x for x in near}
    size: dict[int, float] = {}
    for x, c in comm.items():
        size[c] = size.get(c, 0.0) + k[x]
    moved = total > 0
    while moved:
        moved = False
        for x in sorted(near):
            own = comm[x]
            to = {own: 0.0}
            for y, w in near[x].items():
                if y != x:
                    to[comm[y]] = to.get(comm[y], 0.0) + w
            gain = {c: w - (size[c] - (k[x] if c == own else 0.0)) * k[x] / total for c, w in to.items()}
            best = min(gain, key=lambda c: (-round(gain[c], 9), c))
            if round(gain[best], 9) > round(gain[own], 9) + tolerance:
                size[own] -= k[x]
                size[best] += k[x]
                comm[x] = best
                moved = True
    return comm


def _contracted(edges: list[tuple[int, int, float]], comm: dict[int, int]) -> list[tuple[int, int, float]]:
    out: dict[tuple[int, int], float] = {}
    for a, b, w in edges:
        c, d = comm[a], comm[b]
        key = (max(c, d), min(c, d))
        out[key] = out.get(key, 0.0) + (2 * w if c == d and a != b else w)
    return [(a, b, w) for (a, b), w in out.items()]


def _quality(edges: list[tuple[int, int, float]], comm: dict[int, int]) -> float:
    inside: dict[int, float] = {}
    tot: dict[int, float] = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)) if a != b else ((a, b),):
            tot[comm[x]] = tot.get(comm[x], 0.0) + w
            if comm[x] == comm[y]:
                inside[comm[x]] = inside.get(comm[x], 0.0) + w
    m = sum(tot.values())
    return sum(inside.get(c, 0.0) / m - (t / m) ** 2 for c, t in tot.items()) if m else 0.0


def louvain_in_order(edges: list[tuple[int, int, float]], tolerance: float = 1e-7) -> dict[int, int]:
    """node -> community of a small graph: moves in order, contraction, and again, until nothing is gained or two communities are left."""
    whole = {x: x for e in edges for x in e[:2]}
    q = _quality(edges, whole)
    while True:
        comm = move_in_order(edges)
        new = _quality(edges, comm)
        if new <= q + tolerance:
            return whole
        whole, q = {x: comm[c] for x, c in whole.items()}, new
        edges = _contracted(edges, comm)
        if len(set(comm.values())) <= 2:
            return whole


def louvain(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], levels: int = 100, sweeps: int = 1000, tolerance: float = 1e-7, local: int = LOCAL_EDGES) -> DataFrame:
    """node, comm (its smallest node): local moves until nothing is gained, contraction, and again; ends also at two communities.

    Levels of more than ``local`` edges move in distributed sweeps, of which one
    that lowers modularity is undone, so it never falls; as soon as contraction
    has left no more edges than that, the rest is done in order on the driver.
    ``levels`` and ``sweeps`` are safety bounds: reaching one raises an error.
    """
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    whole = nodes.select("node", F.col("node").alias("comm"))
    for _ in range(levels):
        if e.count() <= local:
            to = louvain_in_order(sorted((r.src, r.dst, r.w) for r in e.collect()), tolerance)
            named = spark.createDataFrame(sorted(to.items()), "comm long, _to long")
            whole = cut(whole.join(F.broadcast(named), "comm").select("node", F.col("_to").alias("comm")))
            break
        comm = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("comm")))
        q = modularity(e, comm).first()[0]
        begun, still = q, 0
        for sweep in range(sweeps):
            nxt = cut(move(e, comm, sweep))
            new = modularity(e, nxt).first()[0]
            if new is None or new <= q + tolerance:
                still += 1
                if still == 3:
                    break
                continue
            comm, q, still = nxt, new, 0
        else:
            raise RuntimeError(f"louvain: still gaining after {sweeps} sweeps of a level")
        if q is None or q <= begun + tolerance:
            break
        whole = cut(whole.join(comm.select(F.col("node").alias("comm"), F.col("comm").alias("_to")), "comm").select("node", F.col("_to").alias("comm")))
        e = cut(contract(e, comm))
        if comm.select("comm").distinct().count() == 2:
            break
    else:
        raise RuntimeError(f"louvain: still gaining after {levels} levels")
    low = whole.groupBy("comm").agg(F.min("node").alias("_low"))
    return whole.join(low, "comm").select("node", F.col("_low").alias("comm"))
