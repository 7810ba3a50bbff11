"""Training under defences: label noise in stages, and repair of trees grown on noised labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrove.frame import VerticalFrame
from veilgrove.operators import privacy as D
from veilgrove.plans import grow as G


def staged_noise(frame: VerticalFrame, p: G.Params, epsilon: float, cut: Callable[[DataFrame], DataFrame], stages: int = 2, kind: str = "forest", outside: str = "top", seed: int = 0) -> tuple[G.Model, VerticalFrame]:
    """A model fitted on noised labels only, and the frame with those labels.

    Rows fall into ``stages`` chunks by a hash of their id.  The first chunk is
    noised under a uniform prior; each later one under the predictions of a
    model that the active party fits on the chunks noised before it.
    """
    k = frame.num_classes
    chunk = F.pmod(F.xxhash64(F.col(frame.row_id).cast("string"), F.lit(seed)), F.lit(stages))
    u, v = D.uniform(F.col(frame.row_id), 2 * seed + 1), D.uniform(F.col(frame.row_id), 2 * seed + 2)
    data = frame.data.withColumn("_chunk", chunk)
    done = None
    for m in range(stages):
        own = data.where(F.col("_chunk") == m)
        if done is None:
            prior = F.array(*[F.lit(1.0 / k)] * k)
        else:
            active = frame.party(p.active_party)._replace(data=done)
            model = G.fit(_renumbered(active), replace(p, active_only=True), kind)
            prior = F.array(*G.probabilities(model))
        answer = D.randomised(F.col("y"), D.ranked(prior), D.k_star_column(prior, epsilon), epsilon, u, v, k, outside)
        noised = own.withColumn("y", answer.cast("int"))
        done = cut(noised if done is None else done.unionByName(noised))
    out = frame._replace(data=done.drop("_chunk"))
    return G.fit(out, p, kind), out


def _renumbered(frame: VerticalFrame) -> VerticalFrame:
    return frame._replace(features=tuple(f._replace(feature_id=k) for k, f in enumerate(frame.features)))


def contaminated(frame: VerticalFrame, model: G.Model, noised: DataFrame) -> dict[tuple[int, int], bool]:
    """(tree, leaf) -> whether its majority label by the noised labels is not its true one; ``noised`` has the row's id and z."""
    placed = G.assignments(frame, model).join(noised, frame.row_id)
    return {(r.tree, r.node): r.mismatch for r in D.mismatched(placed, ["tree", "node"], "z", "y").collect()}


def repair_roots(model: G.Model, bad: dict[tuple[int, int], bool], counts: Callable[[int, int], bool], whole_tree: bool = True) -> list[tuple[int, int]]:
    """Clean nodes with a contaminated child, topmost first; a contaminated root is repaired whole if asked.

    ``counts`` says whether an inner node's own majority is contaminated.
    """
    out = []

    def walk(tree: int, node: int) -> None:
        x = model.nodes[tree, node]
        if x.leaf:
            return
        kids = [(tree, 2 * node + s) for s in (0, 1)]
        if any(bad.get(q, False) if model.nodes[q].leaf else counts(*q) for q in kids):
            out.append((tree, node))
            return
        for _, q in kids:
            walk(tree, q)

    for tree in range(model.n_trees):
        if (tree, 1) not in model.nodes:
            continue
        if counts(tree, 1) and not model.nodes[tree, 1].leaf:
            if whole_tree:
                out.append((tree, 1))
        else:
            walk(tree, 1)
    return out


def repair(frame: VerticalFrame, model: G.Model, noised: DataFrame) -> G.Model:
    """Subtrees below contamination grown anew by the active party, on its features and the true labels."""
    bad = contaminated(frame, model, noised)
    inner = _inner(frame, model, noised)
    roots = repair_roots(model, bad, lambda t, n: inner.get((t, n), False))
    fixed = model._replace(nodes={k: replace(x) for k, x in model.nodes.items()}, params=replace(model.params, active_only=True))
    start = []
    for tree, node in roots:
        x = fixed.nodes[tree, node]
        for key in [k for k in fixed.nodes if k[0] == tree and k[1] != node and _below(k[1], node)]:
            del fixed.nodes[key]
        start.append(G.Node(tree, node, x.depth_left, x.n, list(x.counts), restricted=x.restricted))
    if start:
        true = _true_counts(frame, model, [(x.tree, x.node) for x in start])
        for x in start:
            x.counts = true[x.tree, x.node]
            x.n = sum(x.counts)
        G._grow(frame.data, fixed, start, 0)
    return fixed._replace(params=model.params)


def _below(node: int, top: int) -> bool:
    while node > top:
        node //= 2
    return node == top


def _expanded(frame: VerticalFrame, model: G.Model) -> DataFrame:
    """tree, row, y, node for the leaf of a row and all nodes above it."""
    a = G.assignments(frame, model)
    up = F.sequence(F.lit(0), F.floor(F.log2(F.col("node").cast("double")) + 1e-9).cast("int"))
    return a.withColumn("node", F.explode(F.transform(up, lambda s: F.floor(F.col("node") / F.pow(F.lit(2.0), s)).cast("int"))))


def _inner(frame: VerticalFrame, model: G.Model, noised: DataFrame) -> dict[tuple[int, int], bool]:
    placed = _expanded(frame, model).join(noised, frame.row_id)
    return {(r.tree, r.node): r.mismatch for r in D.mismatched(placed, ["tree", "node"], "z", "y").collect()}


def _true_counts(frame: VerticalFrame, model: G.Model, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    got = _expanded(frame, model).groupBy("tree", "node", "y").count().collect()
    out = {k: [0] * frame.num_classes for k in wanted}
    for r in got:
        if (r.tree, r.node) in out:
            out[r.tree, r.node][r.y] = r["count"]
    return out
