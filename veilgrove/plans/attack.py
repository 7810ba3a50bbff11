"""What a party sees of a model's leaves, and the graphs and components it can build from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrove.frame import VerticalFrame
from veilgrove.operators import graph as R
from veilgrove.plans import grow as G


def visible(model: G.Model, tree: int, free_rider: bool = False, target: bool = True) -> dict[int, int]:
    """leaf -> group: the leaf itself, or an ancestor below which the attacker sees no split.

    Children hidden by the label owner's last split, and those under a bound,
    come as their parent; with ``free_rider`` any two sibling leaves do.  Without
    a ``target`` party, as for an observer of the whole model, nothing is hidden.
    """
    out: dict[int, int] = {}

    def under(node: int, group: int) -> None:
        x = model.nodes[tree, node]
        if x.leaf:
            out[node] = group
        else:
            under(2 * node, group)
            under(2 * node + 1, group)

    def walk(node: int) -> None:
        x = model.nodes[tree, node]
        if x.leaf:
            out[node] = node
            return
        a, b = model.nodes[tree, 2 * node], model.nodes[tree, 2 * node + 1]
        hidden = (a.not_splitted and b.not_splitted) or (a.restricted and b.restricted)
        if (target and hidden) or (free_rider and a.leaf and b.leaf):
            under(node, node)
            return
        walk(2 * node)
        walk(2 * node + 1)

    walk(1)
    return out


def groups(frame: VerticalFrame, model: G.Model, skip: int = 0, eta: float | None = None, free_rider: bool = False, target: bool = True) -> DataFrame:
    """tree, grp, row_id, w: rows that a tree keeps together; boosted trees weigh eta^(tree - skip)."""
    each = []
    for t in range(skip, model.n_trees):
        to = visible(model, t, free_rider, target)
        place = F.create_map(*[F.lit(v) for kv in to.items() for v in kv])
        weight = 1.0 if eta is None else eta ** (t - skip)
        each.append(F.struct(F.lit(t).alias("tree"), F.get(F.array(F.element_at(place, G.leaves(frame, model, t))), F.lit(0)).alias("grp"), F.lit(float(weight)).alias("w")))
    rows = frame.data.select(F.col(frame.row_id).alias("row_id"), F.explode(F.array(*each)).alias("a"))
    return rows.select("a.tree", "a.grp", "row_id", "a.w").where("grp IS NOT NULL")


#: Weight of the link between two chunks of a group.
LINK = 100.0


def adjacency(frame: VerticalFrame, model: G.Model, chunk: int | None = None, link: float = LINK, **kw: object) -> DataFrame:
    """src > dst, w; groups of more than ``chunk`` rows become chunks with links of weight ``link`` instead of one clique."""
    g = groups(frame, model, **kw)
    if chunk is None:
        return R.clique_edges(g, ["tree", "grp"], weight=F.col("w"))
    cut_up, links = R.chunked(g, ["tree", "grp"], chunk)
    return R.add_edges(R.clique_edges(cut_up, ["tree", "grp", "chunk"], weight=F.col("w")), links.withColumn("w", F.lit(float(link))))


def union_attack(frame: VerticalFrame, model: G.Model, cut: Callable[[DataFrame], DataFrame], **kw: object) -> DataFrame:
    """row_id, root: rows that any tree's groups connect."""
    g = groups(frame, model, **kw)
    return R.components(R.star_edges(g, ["tree", "grp"]), cut, frame.data.select(F.col(frame.row_id).alias("row_id")))


def singleton_ratio(frame: VerticalFrame, model: G.Model) -> DataFrame:
    sizes = groups(frame, model).groupBy("tree", "grp").agg(F.count("*").alias("n"))
    return sizes.agg(F.avg((F.col("n") == 1).cast("int")).alias("ratio"))
