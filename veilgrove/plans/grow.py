"""Level-wise growth of forests and boosted trees over a vertical frame.

One job grows a whole level of all trees: rows are projected to their nodes by
an expression compiled from the trees so far, histograms are aggregated by
(tree, node, feature, value), and the best split of each node, one small row,
comes back to the driver.  Rows are never moved and no assignment table is kept;
the model is what the driver holds, bounded by trees and depth.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.frame import Feature, VerticalFrame
from veilgrove.functions import scalar as S
from veilgrove.operators import split as P
from veilgrove.storage import cut as checkpointed


@dataclass(frozen=True)
class Params:
    """``bins``: None for exact thresholds, else approximate quantiles fixed before growth, for large data."""

    trees: int = 1
    depth: int = 6
    min_leaf: int = 1
    row_ratio: float = 1.0
    col_ratio: float = 1.0
    seed: int = 0
    bins: int | None = None
    lam: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = -math.inf
    min_gain: float = -math.inf
    rate: float = 0.3
    init: float = 0.0
    active_party: int = 0
    mi_bound: float | None = None
    active_only: bool = False
    secure_rounds: int = 0
    use_missing: bool = False

    def __post_init__(self) -> None:
        if self.trees < 0 or self.depth < 0 or self.min_leaf < 1:
            raise ValueError("trees and depth are not negative, min_leaf is positive")
        if not (0 < self.row_ratio <= 1 and 0 < self.col_ratio <= 1):
            raise ValueError("ratios lie in (0, 1]")


@dataclass
class Node:
    tree: int
    node: int
    depth_left: int
    n: int
    counts: list[int]
    g: list[float] = field(default_factory=list)
    h: list[float] = field(default_factory=list)
    party: int | None = None
    feature: int | None = None
    threshold: float | None = None
    missing_left: bool = False
    score: float | None = None
    #: Splits of passive parties among which this one was found.
    offers: int = 0
    leaf: bool = True
    value: list[float] = field(default_factory=list)
    restricted: bool = False
    not_splitted: bool = False
    record: int | None = None


class Model(NamedTuple):
    kind: str
    features: tuple[Feature, ...]
    num_classes: int
    params: Params
    nodes: dict[tuple[int, int], Node]
    n_trees: int
    log: list[dict]
    row_id: str = "row_id"
    #: Of each tree, the largest hash of a row that it is grown on; none for all rows.
    drawn: dict[int, int] | None = None

    def lookup_sizes(self) -> dict[int, int]:
        """Splits that each party has recorded."""
        out: dict[int, int] = {}
        for x in self.nodes.values():
            if not x.leaf:
                out[x.party] = out.get(x.party, 0) + 1
        return out


# -- compiled trees -------------------------------------------------------------------------------
def goes_left(model: Model, x: Node) -> Column:
    c = F.col(model.features[x.feature].name)
    return F.when(c.isNull(), F.lit(x.missing_left)).otherwise(c <= x.threshold)


def walk(model: Model, tree: int, at_leaf: Callable[[Node], Column], node: int = 1) -> Column:
    """An expression over the frame's columns that follows one tree to its leaf."""
    x = model.nodes[tree, node]
    if x.leaf:
        return at_leaf(x)
    return F.when(goes_left(model, x), walk(model, tree, at_leaf, 2 * node)).otherwise(walk(model, tree, at_leaf, 2 * node + 1))


class Vault(Protocol):
    """How passive parties' sums are made where they must not see what they add up (``plans.secure``)."""

    def seal(self, data: DataFrame, named: dict[str, Column]) -> DataFrame: ...

    def histogram(self, rows: DataFrame, features: dict[int, list[Feature]], cols: list[str]) -> DataFrame: ...


def _hash(row_id: str, p: Params, tree: int) -> Column:
    return F.xxhash64(F.col(row_id).cast("string"), F.lit(p.seed + tree))


def draw(data: DataFrame, p: Params, trees: list[int], row_id: str, few: int = 4096) -> dict[int, int] | None:
    """Of each tree, the int(ratio * n)-th smallest hash of the rows' ids: a draw of exactly so many rows without replacement.

    Hashes are counted in 4096 ranges, then in the range that holds the wanted
    rank, until that is down to ``few`` rows, which come to the driver.
    """
    if p.row_ratio >= 1 or not trees:
        return None
    k = int(p.row_ratio * data.count())
    out: dict[int, int] = {}
    # tree -> (bits fixed so far, their value, rows before them)
    at = {t: (0, 0, 0) for t in trees}
    while at:
        bits = min(next(iter(at.values()))[0] + 12, 64)
        own = F.array(*[F.struct(F.lit(t).alias("t"), (_hash(row_id, p, t).bitwiseXOR(F.lit(-(2**63)))).alias("h")) for t in at])
        rows = data.select(F.explode(own).alias("s")).select("s.t", "s.h")
        fixed = None
        for t, (done, value, _) in at.items():
            here = (F.col("t") == t) & (F.shiftrightunsigned("h", 64 - done) == value if done else F.lit(True))
            fixed = here if fixed is None else fixed | here
        rows = rows.where(fixed)
        counts: dict[int, dict[int, int]] = {t: {} for t in at}
        for r in rows.groupBy("t", F.shiftrightunsigned("h", 64 - bits).alias("b")).count().collect():
            counts[r.t][r.b % 2**64] = r["count"]
        ready = {}
        for t, (_, _, before) in list(at.items()):
            for b in sorted(counts[t]):
                if before + counts[t][b] >= k:
                    break
                before += counts[t][b]
            at[t] = (bits, b, before)
            if counts[t][b] <= few or bits == 64:
                ready[t] = at.pop(t)
        if ready:
            wanted = None
            for t, (done, value, _) in ready.items():
                here = (F.col("t") == t) & (F.shiftrightunsigned("h", 64 - done) == F.lit(value if value < 2**63 else value - 2**64))
                wanted = here if wanted is None else wanted | here
            held: dict[int, list[int]] = {t: [] for t in ready}
            for r in rows.where(wanted).collect():
                held[r.t].append(r.h % 2**64)
            for t, (_, _, before) in ready.items():
                out[t] = sorted(held[t])[k - before - 1] - 2**63 if k else -(2**63) - 1
    return out


def in_sample(model: Model, tree: int) -> Column:
    """Whether a row is drawn for a tree: by a hash of its id, so any task can tell."""
    limit = (model.drawn or {}).get(tree)
    if limit is None:
        return F.lit(True)
    return _hash(model.row_id, model.params, tree) <= limit if limit >= -(2**63) else F.lit(False)


def sampled_features(features: tuple[Feature, ...], p: Params, tree: int) -> list[Feature]:
    """The first int(ratio * m) of each party's features in the order of a hash."""
    if p.col_ratio >= 1:
        return list(features)
    mixed = lambda f: ((f.feature_id + 1) * 2654435761 + (p.seed + tree) * 40503) % 2**32
    out = []
    for party in sorted({f.party_id for f in features}):
        own = sorted((f for f in features if f.party_id == party), key=mixed)
        out += own[: int(p.col_ratio * len(own))]
    return sorted(out, key=lambda f: f.feature_id)


# -- one level ------------------------------------------------------------------------------------
def _sums(num_classes: int, outputs: int) -> tuple[list[Column], list[str]]:
    named = [f"{s}{k}" for k in range(outputs) for s in ("g", "h")]
    return P.class_counts(F.col("y"), num_classes) + [F.sum(c).alias(c) for c in named], ["n", *[f"c{k}" for k in range(num_classes)], *named]


def _binned(frame: VerticalFrame, bins: int) -> VerticalFrame:
    """Features rounded up to approximate quantiles of all rows; materialised, since every level reads them."""
    cuts = [k / bins for k in range(1, bins + 1)]
    got = frame.data.select(*[F.percentile_approx(f.name, cuts, 10 * bins).alias(f.name) for f in frame.features]).first()

    def up(name: str, edges: list[float]) -> Column:
        if not edges:
            return F.col(name)
        above = F.get(F.filter(F.array(*map(F.lit, edges)), lambda t: t >= F.col(name)), F.lit(0))
        return F.when(F.col(name).isNotNull(), F.coalesce(above, F.lit(edges[-1])))

    cols = {f.name: up(f.name, sorted(set(got[f.name] or ()))) for f in frame.features}
    return frame._replace(data=checkpointed(frame.data.withColumns(cols)))


def _level(data: DataFrame, model: Model, open_nodes: list[Node], outputs: int, vault: Vault | None = None) -> list[dict]:
    """The best split of every open node, if it has any."""
    p, k = model.params, model.num_classes
    sums, cols = _sums(k, outputs)
    trees = sorted({x.tree for x in open_nodes})
    features = {t: sampled_features(model.features, p, t) for t in trees}
    if not any(features.values()):
        return []
    places = {}
    for tree in trees:
        here = {x.node for x in open_nodes if x.tree == tree}
        places[tree] = F.when(in_sample(model, tree), walk(model, tree, lambda x, h=here: F.lit(x.node) if x.node in h else F.lit(None).cast("int")))
    # One small row for each open node: its sums, those of its tree's root, and whether only the active party may split it.
    names = [f"all_{c}" for c in cols] + [f"root_c{i}" for i in range(k)]
    known = F.broadcast(
        data.sparkSession.createDataFrame(
            [(x.tree, x.node, bool(x.restricted or p.active_only), *[float(v) for v in [x.n, *x.counts, *[v for gh in zip(x.g, x.h, strict=True) for v in gh], *model.nodes[x.tree, 1].counts]]) for x in open_nodes],
            "tree int, node int, closed boolean, " + ", ".join(f"{c} double" for c in names),
        )
    )
    keys = ["tree", "node", "party", "feature"]
    extra = [c for c in data.columns if c[0] in "gh" and c[1:].isdigit()]

    def cells_of(wanted: Callable[[Feature], bool]) -> DataFrame:
        pieces = []
        for tree in trees:
            cells = F.array(*[F.struct(F.lit(f.party_id).alias("party"), F.lit(f.feature_id).alias("feature"), F.col(f.name).alias("x")) for f in features[tree] if wanted(f)])
            if any(map(wanted, features[tree])):
                pieces.append(F.struct(F.lit(tree).alias("tree"), places[tree].alias("node"), cells.alias("cells")))
        rows = data.select("y", *extra, F.explode(F.filter(F.array(*pieces), lambda s: s["node"].isNotNull())).alias("_t"))
        return rows.select("y", *extra, "_t.tree", "_t.node", F.explode("_t.cells").alias("_c")).select("y", *extra, "tree", "node", "_c.party", "_c.feature", "_c.x")

    shut = any(x.restricted or p.active_only for x in open_nodes)
    everywhere = shut and all(x.restricted or p.active_only for x in open_nodes)
    mine = lambda f: f.party_id == p.active_party
    parts = []
    if vault is None:
        if any(mine(f) or not everywhere for own in features.values() for f in own):
            cells = cells_of(mine if everywhere else lambda f: True)
            if shut and not everywhere:
                cells = cells.join(known.select("tree", "node", "closed"), ["tree", "node"]).where((F.col("party") == p.active_party) | ~F.col("closed"))
            parts.append(P.histogram(cells, keys, sums))
    else:
        if any(mine(f) for own in features.values() for f in own):
            parts.append(P.histogram(cells_of(mine), keys, sums))
        passive = {t: [f for f in own if not mine(f)] for t, own in features.items()}
        if not everywhere and any(passive.values()):
            free = {(x.tree, x.node) for x in open_nodes if not (x.restricted or p.active_only)}
            at = F.array(*[F.struct(F.lit(t).alias("tree"), places[t].alias("node")) for t in trees if passive[t]])
            spots = F.filter(at, lambda s: F.struct(s["tree"], s["node"]).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(free)]))
            rows = data.select("*", F.explode(spots).alias("_s")).select("*", "_s.tree", "_s.node")
            parts.append(vault.histogram(rows, passive, cols[1:]))
    if not parts:
        return []
    hist = parts[0]
    for part in parts[1:]:
        hist = hist.unionByName(part)
    # Materialised, since block bounds, block sums and running sums each read it.
    hist = checkpointed(hist)
    run = P.cumulative(hist, keys, "x", cols, blocks=16)
    run = run.join(known, ["tree", "node"])
    run = run.join(P.totals(hist, keys, cols), keys)  # of rows that are not missing
    directions = [F.lit(False)] + ([F.lit(True)] if p.use_missing else [])
    run = run.withColumn("missing_left", F.explode(F.array(*directions))).where(~F.col("missing_left") | (F.col("tot_n") < F.col("all_n")))
    left = {c: F.col(f"cum_{c}") + F.when(F.col("missing_left"), F.col(f"all_{c}") - F.col(f"tot_{c}")).otherwise(0) for c in cols}
    run = run.select(*keys, "x", "missing_left", *[left[c].cast("double").alias(f"l_{c}") for c in cols], *names)
    run = run.where((F.col("l_n") >= p.min_leaf) & (F.col("all_n") - F.col("l_n") >= p.min_leaf))
    lc, ac = [F.col(f"l_c{i}") for i in range(k)], [F.col(f"all_c{i}") for i in range(k)]
    if outputs:
        lg, lh = [[F.col(f"l_{s}{i}") for i in range(outputs)] for s in "gh"]
        ag, ah = [[F.col(f"all_{s}{i}") for i in range(outputs)] for s in "gh"]
        if p.min_child_weight > -math.inf:
            for a, b in zip(lh, ah, strict=True):
                run = run.where((a >= p.min_child_weight) & (b - a >= p.min_child_weight))
        score = S.gain(lg, lh, ag, ah, p.lam, p.gamma)
    else:
        score = S.split_score(lc, ac)
    if p.mi_bound is not None:
        root = [F.col(f"root_c{i}") for i in range(k)]
        run = run.where((F.col("party") == p.active_party) | (lmir_ok(lc, root, p.mi_bound) & lmir_ok([a - b for a, b in zip(ac, lc, strict=True)], root, p.mi_bound)))
    scored = run.withColumn("score", F.round(score, 9)).where(F.col("score") > p.min_gain)
    keep = ["party", "feature", "x", "missing_left", *[f"l_{c}" for c in cols]]
    return [r.asDict() for r in P.best(scored, ["tree", "node"], ["party", "feature", "missing_left", "x"], keep, {"passive": F.count(F.when(F.col("party") != p.active_party, 1))}).collect()]


def lmir_ok(inside: list[Column], entire: list[Column], bound: float) -> Column:
    """Both the node and its complement in its tree diverge from the tree's prior by at most the bound; a bound of 0 or less lets all pass."""
    if bound <= 0:
        return F.lit(True)
    n = S.total(entire)
    prior = [c / n for c in entire]
    outside = [e - c for e, c in zip(entire, inside, strict=True)]
    return F.greatest(S.divergence(inside, prior), S.divergence(outside, prior)) <= bound


def _lmir_plain(counts: list[int], entire: list[int], bound: float | None) -> bool:
    if bound is None or bound <= 0:
        return True

    def kl(c: list[int]) -> float:
        n = sum(c)
        return sum(v / n * math.log(S.EPS + (v / n) / (e / sum(entire))) for v, e in zip(c, entire, strict=True)) if n else 0.0

    return max(kl(counts), kl([e - c for e, c in zip(entire, counts, strict=True)])) <= bound


def _grow(data: DataFrame, model: Model, roots: list[Node], outputs: int, vault: Vault | None = None) -> None:
    """Grow all subtrees below ``roots`` together, level by level, in place."""
    p = model.params

    def close(x: Node) -> None:
        x.leaf = True
        x.value = [S_value(g, h, p.lam) for g, h in zip(x.g, x.h, strict=True)] if outputs else [c / x.n if x.n else 0.0 for c in x.counts]

    level = list(roots)
    for x in roots:
        model.nodes[x.tree, x.node] = x
    while level:
        open_nodes = []
        for x in level:
            close(x)
            if x.depth_left > 0 and x.n and max(x.counts) < x.n:
                open_nodes.append(x)
        if not open_nodes:
            return
        level = []
        cols = _sums(model.num_classes, outputs)[1]
        found = _level(data, model, open_nodes, outputs, vault)
        for b in sorted(found, key=lambda r: (r["tree"], r["node"])):
            x = model.nodes[b["tree"], b["node"]]
            x.leaf, x.party, x.feature, x.threshold, x.missing_left, x.score = False, b["party"], b["feature"], b["x"], b["missing_left"], b["score"]
            x.offers = b["passive"]
            x.record = sum(1 for y in model.nodes.values() if not y.leaf and y.party == x.party) - 1
            left = {c: b[f"l_{c}"] for c in cols}
            k = model.num_classes
            sides = []
            for s in (0, 1):
                take = (lambda c, own: left[c]) if s == 0 else (lambda c, own: own - left[c])
                counts = [int(take(f"c{i}", x.counts[i])) for i in range(k)]
                g = [take(f"g{i}", x.g[i]) for i in range(outputs)]
                h = [take(f"h{i}", x.h[i]) for i in range(outputs)]
                sides.append(Node(x.tree, 2 * x.node + s, x.depth_left - 1, int(take("n", x.n)), counts, g, h, restricted=x.restricted))
            entire = model.nodes[x.tree, 1].counts
            if not all(_lmir_plain(y.counts, entire, p.mi_bound) for y in sides):
                for y in sides:
                    y.restricted = True
            for y in sides:
                model.nodes[y.tree, y.node] = y
            level += sides
    return


def S_value(g: float, h: float, lam: float) -> float:
    return -g / (h + lam) if h + lam else 0.0


def mark_hidden(model: Model) -> None:
    """Leaves whose split the label owner holds are not seen as split by others."""
    for x in list(model.nodes.values()):
        if not x.leaf:
            a, b = (model.nodes[x.tree, 2 * x.node + s] for s in (0, 1))
            if a.leaf and b.leaf and x.party == model.params.active_party:
                a.not_splitted = b.not_splitted = True


def _root_stats(data: DataFrame, model: Model, trees: list[int], outputs: int) -> dict[int, dict]:
    """Counts and sums of every tree's rows, in one job."""
    sums, cols = _sums(model.num_classes, outputs)
    member = F.array(*[F.when(in_sample(model, t), F.lit(t)) for t in trees])
    got = data.select("*", F.explode(F.filter(member, lambda t: t.isNotNull())).alias("tree")).groupBy("tree").agg(F.count("*").alias("n"), *sums).collect()
    empty = dict.fromkeys(cols, 0)
    return {t: next((r.asDict() for r in got if r.tree == t), empty) for t in trees}


def _root(tree: int, depth: int, stats: dict, num_classes: int, outputs: int) -> Node:
    return Node(tree, 1, depth, stats["n"], [stats[f"c{k}"] or 0 for k in range(num_classes)], [float(stats[f"g{k}"] or 0) for k in range(outputs)], [float(stats[f"h{k}"] or 0) for k in range(outputs)])


# -- models ------------------------------------------------------------------------------------------
def fit_forest(frame: VerticalFrame, p: Params, vault: Vault | None = None) -> Model:
    """Independent trees on gini impurity, all grown in the same jobs; behind ``vault``, passive parties add up sealed class marks."""
    grown = _binned(frame, p.bins) if p.bins else frame
    trees = list(range(p.trees))
    model = Model("forest", frame.features, frame.num_classes, p, {}, p.trees, [], frame.row_id, draw(grown.data, p, trees, frame.row_id))
    if trees:
        data = grown.data if vault is None else checkpointed(vault.seal(grown.data, class_marks(frame.num_classes)))
        stats = _root_stats(data, model, trees, 0)
        _grow(data, model, [_root(t, p.depth, stats[t], frame.num_classes, 0) for t in trees], 0, vault)
    mark_hidden(model)
    for t in trees:
        model.log.append(_entry(model, t, None))
    return model


def class_marks(num_classes: int) -> dict[str, Column]:
    return {f"c{k}": (F.col("y") == k).cast("double") for k in range(num_classes)}


def _entry(model: Model, tree: int, loss: float | None) -> dict:
    """What is logged of a tree: its loss, purity, leaves, and the splits that passive parties offered."""
    own = [x for x in model.nodes.values() if x.tree == tree]
    n = model.nodes[tree, 1].n if (tree, 1) in model.nodes else 0
    leaves = [x for x in own if x.leaf]
    purity = sum(max(x.counts, default=0) for x in leaves) / n if n else None
    return {"round": tree, "loss": loss, "rows": n, "leaves": len(leaves), "purity": purity, "offers": sum(x.offers for x in own)}


LOG = "round int, loss double, rows long, leaves int, purity double, offers long"


def log_frame(data: DataFrame, model: Model) -> DataFrame:
    """The log as rows, one for each tree."""
    return data.sparkSession.createDataFrame([tuple(e.values()) for e in model.log], LOG)


def logits(model: Model) -> list[Column]:
    """Raw scores: one for two classes, else one for each."""
    outputs = 1 if model.num_classes == 2 else model.num_classes
    out = []
    for k in range(outputs):
        score = F.lit(float(model.params.init))
        for t in range(model.n_trees):
            score = score + model.params.rate * walk(model, t, lambda x, k=k: F.lit(float(x.value[k])))
        out.append(score)
    return out


def probabilities(model: Model) -> list[Column]:
    k = model.num_classes
    if not model.n_trees:
        return [F.lit(1.0 / k)] * k
    if model.kind == "forest":
        return [S.total([walk(model, t, lambda x, c=c: F.lit(float(x.value[c]))) for t in range(model.n_trees)]) / model.n_trees for c in range(k)]
    raw = logits(model)
    if k == 2:
        q = S.sigmoid(raw[0])
        return [1 - q, q]
    return S.softmax(raw)


def predict(frame: VerticalFrame, model: Model) -> DataFrame:
    """row_id, y and p0..: trees are broadcast as expressions, so this is a projection of the scan."""
    return frame.data.select(frame.row_id, frame.label, *[p.alias(f"p{k}") for k, p in enumerate(probabilities(model))])


def fit_boosting(frame: VerticalFrame, p: Params, cut: Callable[[DataFrame], DataFrame] | None = None, start: Model | None = None, vault: Vault | None = None, log_loss: bool = False) -> Model:
    """Rounds of second-order boosting; ``start`` continues a model, ``cut`` materialises the scores after a round.

    Behind ``vault``, passive parties add up sealed gradients, hessians and class
    marks; ``log_loss`` takes one more aggregation a round.
    """
    k = frame.num_classes
    outputs = 1 if k == 2 else k
    grown = _binned(frame, p.bins) if p.bins else frame
    begun = start.n_trees if start else 0
    drawn = draw(grown.data, p, list(range(begun, begun + p.trees)), frame.row_id)
    if start and start.drawn:
        drawn = {**start.drawn, **(drawn or {})}
    model = Model("boosting", frame.features, k, p, dict(start.nodes) if start else {}, begun, list(start.log) if start else [], frame.row_id, drawn)
    scored = grown.data.withColumns({f"s{c}": x for c, x in enumerate(logits(model))})
    raw = [F.col(f"s{c}") for c in range(outputs)]
    probs = [S.sigmoid(raw[0])] if k == 2 else S.softmax(raw)
    for r in range(begun, begun + p.trees):
        g = [S.bce_gradient(F.col("y"), probs[0])] if k == 2 else S.ce_gradients(F.col("y"), probs)
        h = [S.bce_hessian(q) for q in probs]
        named = {**{f"g{c}": x for c, x in enumerate(g)}, **{f"h{c}": x for c, x in enumerate(h)}}
        data = scored.withColumns(named)
        if vault is not None:
            data = checkpointed(vault.seal(data, {**class_marks(k), **{c: F.col(c) for c in named}}))
        secure = p.active_only or r < p.secure_rounds
        step = model._replace(params=replace(p, active_only=secure))
        stats = _root_stats(data, model, [r], outputs)
        _grow(data, step, [_root(r, p.depth, stats[r], k, outputs)], outputs, vault)
        scored = scored.withColumns({f"s{c}": F.col(f"s{c}") + p.rate * walk(model, r, lambda x, c=c: F.lit(float(x.value[c]))) for c in range(outputs)})
        if cut is not None:
            scored = cut(scored)
        model = model._replace(n_trees=r + 1)
        loss = S.bce_loss(F.col("y"), probs[0]) if k == 2 else S.ce_loss(F.col("y"), probs)
        model.log.append(_entry(model, r, scored.agg((F.avg if k == 2 else F.sum)(loss)).first()[0] if log_loss else None))
    mark_hidden(model)
    return model


def fit(frame: VerticalFrame, p: Params, kind: str = "forest") -> Model:
    return fit_forest(frame, p) if kind == "forest" else fit_boosting(frame, p)


def leaves(frame: VerticalFrame, model: Model, tree: int) -> Column:
    """The leaf of each row in a tree; null for rows that the tree was not grown on."""
    return F.when(in_sample(model, tree), walk(model, tree, lambda x: F.lit(x.node)))


def assignments(frame: VerticalFrame, model: Model) -> DataFrame:
    """tree, row_id, y, node: where each tree puts the rows it was grown on."""
    each = F.array(*[F.struct(F.lit(t).alias("tree"), leaves(frame, model, t).alias("node")) for t in range(model.n_trees)])
    return frame.data.select(frame.row_id, frame.label, F.explode(each).alias("a")).select("a.tree", frame.row_id, frame.label, "a.node").where("node IS NOT NULL")


def leaf_purity(model: Model, total: int, tree: int, of_sample: bool = False) -> float:
    """Share of rows in their leaf's majority class; of all rows, or of those the tree was grown on."""
    own = [x for x in model.nodes.values() if x.tree == tree and x.leaf]
    n = sum(x.n for x in own) if of_sample else total
    return sum(max(x.counts, default=0) for x in own) / n if n else float("nan")
