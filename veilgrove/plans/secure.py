"""Training under encryption: passive parties add up what they cannot read.

The label owner seals class marks, gradients and hessians row by row, once a
tree level by level uses them.  A passive party groups the sealed values by its
own features and adds them up, multiplying ciphertexts, partially before the
shuffle, all columns in one pass.  The owner opens the sums of a level, from
which the search for splits goes on as in the plain: the owner's own features
never leave the open, so with the same draw a model is the one that plain growth
gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.frame import Feature, VerticalFrame
from veilgrove.functions import paillier as H
from veilgrove.functions import scalar as S
from veilgrove.plans import grow as G

#: Least step of sealed numbers: a power of sixteen, so whole halves and quarters are exact.
PRECISION = 16.0**-6
#: Of gradients in training, so that scores agree with plain ones in nine digits.
FINE = 16.0**-12


def sealed(data: DataFrame, named: dict[str, Column], pub: H.PublicKey, row_id: str = "row_id", sec: H.SecretKey | None = None) -> DataFrame:
    """row_id and a ciphertext for each named value."""
    plain = data.select(row_id, *[c.cast("double").alias(k) for k, c in named.items()])
    return plain.select(row_id, *[H.encrypt(pub, PRECISION, sec)(k).alias(k) for k in named])


def sealed_histogram(party: VerticalFrame, secret: DataFrame, names: list[str], pub: H.PublicKey) -> DataFrame:
    """feature_id, x, n and the sealed sum of each named value: all that a passive party sends."""
    cells = party.data.select(party.row_id, F.explode(F.array(*[F.struct(F.lit(f.feature_id).alias("feature_id"), F.col(f.name).alias("x")) for f in party.features])).alias("c"))
    own = cells.select(party.row_id, "c.*").where("x IS NOT NULL").join(secret, party.row_id)
    return H.sums_by(own, ["feature_id", "x"], names, pub)


def opened(sums: DataFrame, names: list[str], sec: H.SecretKey) -> DataFrame:
    return sums.select("feature_id", "x", "n", *[H.decrypt(sec)(k).alias(k) for k in names])


# -- training -------------------------------------------------------------------------------------
class Keys(NamedTuple):
    """The owner's keys, as growth uses them."""

    public: H.PublicKey
    secret: H.SecretKey

    def seal(self, data: DataFrame, named: dict[str, Column]) -> DataFrame:
        """``data`` with a ciphertext for each named value, in a column behind ``enc_``."""
        plain = data.withColumns({f"enc_{k}": c.cast("double") for k, c in named.items()})
        return plain.withColumns({f"enc_{k}": H.encrypt(self.public, FINE, self.secret)(f"enc_{k}") for k in named})

    def histogram(self, rows: DataFrame, features: dict[int, list[Feature]], cols: list[str]) -> DataFrame:
        """tree, node, party, feature, x, n and the opened sums ``cols`` of the rows (tree, node, features, ciphertexts).

        A row goes to the passive party's task once, with all its ciphertexts;
        what is shuffled is a row for each task, node, feature and value.
        """
        pub = self.public
        names = sorted({f.name for own in features.values() for f in own})
        wanted = {t: [(f.party_id, f.feature_id, f.name) for f in own] for t, own in features.items()}

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, list] = {}
            for b in batches:
                marks = [[H.Cipher.of(t) for t in b[f"enc_{c}"].tolist()] for c in cols]
                values = {n: b[n].tolist() for n in names}
                for i, (tree, node) in enumerate(zip(b["tree"].tolist(), b["node"].tolist(), strict=True)):
                    for party, feature, name in wanted.get(tree, ()):
                        x = values[name][i]
                        if x is None or x != x:
                            continue
                        key = (tree, node, party, feature, x)
                        own = total.get(key)
                        if own is None:
                            total[key] = [1, *[m[i] for m in marks]]
                        else:
                            own[0] += 1
                            for j, m in enumerate(marks, 1):
                                own[j] = H.plus(pub, own[j], m[i])
            yield pd.DataFrame([(*k, v[0], *[x.text() for x in v[1:]]) for k, v in total.items()], columns=[*keys, "n", *cols])

        keys = ["tree", "node", "party", "feature", "x"]
        src = rows.select("tree", "node", *names, *[f"enc_{c}" for c in cols])
        parts = src.mapInPandas(partial, "tree int, node int, party int, feature int, x double, n bigint, " + ", ".join(f"{c} string" for c in cols))
        sums = H.sums_of(parts, keys, cols, pub)
        open_ = H.decrypt(self.secret)
        whole = lambda c: F.round(open_(c)).cast("long") if c[0] == "c" else open_(c)
        return sums.select(*keys, "n", *[whole(c).alias(c) for c in cols])


def fit_forest(frame: VerticalFrame, p: G.Params, keys: Keys) -> G.Model:
    """A forest whose passive parties see sealed class marks only."""
    return G.fit_forest(frame, p, keys)


def fit_boosting(frame: VerticalFrame, p: G.Params, keys: Keys, start: G.Model | None = None) -> G.Model:
    """Boosting whose passive parties see sealed gradients, hessians and class marks only."""
    from veilgrove.storage import cut

    return G.fit_boosting(frame, p, cut, start, keys)


def ratios(left: list[Column], inside: list[Column], entire: list[Column]) -> dict[str, list[Column]]:
    """Class shares left and right of a split, and of what lies outside either, by which a bound can be tested without counts."""
    right = [a - b for a, b in zip(inside, left, strict=True)]
    share = lambda c: [x / S.total(c) for x in c]
    rest = lambda c: [e - x for e, x in zip(entire, c, strict=True)]
    return {"left_in": share(left), "right_in": share(right), "left_out": share(rest(left)), "right_out": share(rest(right))}


def ratios_ok(inside: list[Column], outside: list[Column], prior: list[Column], bound: float) -> Column:
    """Whether shares inside and outside a node diverge from the prior by at most the bound; a bound of 0 or less lets all pass."""
    if bound <= 0:
        return F.lit(True)
    kl = lambda r: S.total([x * F.log(S.EPS + x / q) for x, q in zip(r, prior, strict=True)])
    return F.greatest(kl(inside), kl(outside)) <= bound


# -- what is sent ---------------------------------------------------------------------------------
#: The kinds of message of a run over a network, and the numbers they bear there.
MESSAGES = {
    "vec_encrypted_y": 0, "vec_encrypted_grad": 1, "vec_encrypted_hess": 2, "search_results": 3, "instance_space": 4, "encrypted_instance_space": 5, "best_split_col_id": 6, "best_split_threshold_id": 7, "best_instance_space": 8,
    "best_party_id": 9, "depth": 10, "publickey": 11, "recordid": 12, "isleaf": 13, "isleft": 14, "node_party_id": 15, "record_id": 16, "encrypted_y": 17,
}
SENT = "tree int, message string, tag int, sender int, receiver int, messages long, numbers long, ciphertexts long"


def traffic(data: DataFrame, model: G.Model) -> DataFrame:
    """Messages between the active party and each passive one, by tree and kind: how many, and how many plain numbers and ciphertexts they hold.

    Once a tree the owner sends every row's sealed gradients and hessians (class
    marks in a forest); for a node that passive parties may split, its rows and
    depth, and the answer is a candidate for each split they offer; the party
    whose split is chosen gets its column and threshold and returns the left
    rows and the record's number; every party hears whether a node is a leaf.
    """
    p, k = model.params, model.num_classes
    outputs = 1 if k == 2 else k
    parties = sorted({f.party_id for f in model.features} - {p.active_party})
    rows: list[tuple] = []

    def sent(tree: int, kind: str, sender: int, receiver: int, messages: int, numbers: int = 0, ciphertexts: int = 0) -> None:
        if messages:
            rows.append((tree, kind, MESSAGES[kind], sender, receiver, messages, numbers, ciphertexts))

    for party in parties:
        sent(-1, "publickey", p.active_party, party, 1, 2)
    for tree in sorted({t for t, _ in model.nodes}):
        own = [x for (t, _), x in model.nodes.items() if t == tree]
        n = model.nodes[tree, 1].n
        asked = [x for x in own if x.depth_left > 0 and not x.restricted and max(x.counts, default=0) < x.n]
        for party in parties:
            if model.kind == "forest":
                sent(tree, "vec_encrypted_y", p.active_party, party, 1, 0, n * k)
            else:
                for kind in ("vec_encrypted_grad", "vec_encrypted_hess"):
                    sent(tree, kind, p.active_party, party, 1, 0, n * outputs)
            sent(tree, "instance_space", p.active_party, party, len(asked), sum(x.n for x in asked))
            sent(tree, "depth", p.active_party, party, len(asked), len(asked))
            each = k if model.kind == "forest" else 2 * outputs
            sent(tree, "search_results", party, p.active_party, len(asked), 0, sum(x.offers for x in asked) * each // len(parties))
            chosen = [x for x in own if not x.leaf and x.party == party]
            for kind in ("best_split_col_id", "best_split_threshold_id"):
                sent(tree, kind, p.active_party, party, len(chosen), len(chosen))
            sent(tree, "best_instance_space", party, p.active_party, len(chosen), sum(model.nodes[tree, 2 * x.node].n for x in chosen))
            sent(tree, "record_id", party, p.active_party, len(chosen), len(chosen))
            sent(tree, "isleaf", p.active_party, party, len(own), len(own))
    return data.sparkSession.createDataFrame(rows, SENT)
