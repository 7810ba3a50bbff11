"""Pieces of SQL that the oracles share."""

from __future__ import annotations


def after(name: str, with_list: str) -> str:
    """The part of a list of common tables that follows the table ``name``, its comma first."""
    at = with_list.index(f"{name} AS (") + len(name) + 4
    depth = 0
    for k in range(at, len(with_list)):
        depth += (with_list[k] == "(") - (with_list[k] == ")")
        if not depth:
            return with_list[k + 1 :]
    return ""


LI3 = (
    "li AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, "
    "CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS y2, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem)"
)
CELLS = LI3 + (
    ", cells AS (SELECT row_id, y, y2, 0 AS party_id, 0 AS feature_id, quantity AS x FROM li UNION ALL SELECT row_id, y, y2, 0, 1, extendedprice FROM li "
    "UNION ALL SELECT row_id, y, y2, 1, 2, discount FROM li UNION ALL SELECT row_id, y, y2, 1, 3, tax FROM li)"
)
HIST = CELLS + (
    ", hist AS (SELECT party_id, feature_id, x, count(*) AS n, sum((y = 0)::INT) AS c0, sum((y = 1)::INT) AS c1, sum((y = 2)::INT) AS c2 FROM cells GROUP BY ALL)"
)
CUM = HIST + (
    ", run AS (SELECT *, sum(n) OVER w AS cum_n, sum(c0) OVER w AS cum_c0, sum(c1) OVER w AS cum_c1, sum(c2) OVER w AS cum_c2, sum(n) OVER p AS tot_n, sum(c0) OVER p AS tot_c0, "
    "sum(c1) OVER p AS tot_c1, sum(c2) OVER p AS tot_c2 FROM hist WINDOW w AS (PARTITION BY feature_id ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature_id))"
)


def gini(n: str, *counts: str) -> str:
    return "(1 - (" + " + ".join(f"({c})::DOUBLE / nullif({n}, 0) * (({c})::DOUBLE / nullif({n}, 0))" for c in counts) + "))"


_LEFT = gini("cum_n", "cum_c0", "cum_c1", "cum_c2")
_RIGHT = gini("(tot_n - cum_n)", "tot_c0 - cum_c0", "tot_c1 - cum_c1", "tot_c2 - cum_c2")
SCORE = f"round({gini('tot_n', 'tot_c0', 'tot_c1', 'tot_c2')} - cum_n::DOUBLE / tot_n * coalesce({_LEFT}, 0) - (1 - cum_n::DOUBLE / tot_n) * coalesce({_RIGHT}, 0), 9)"
SCORED = CUM + f", scored AS (SELECT *, {SCORE} AS score FROM run WHERE cum_n >= 1 AND tot_n - cum_n >= 1)"

XGB = CELLS + (
    ", hist AS (SELECT party_id, feature_id, x, count(*) AS n, sum(0.5 - y2) AS g, sum(0.25) AS h FROM cells GROUP BY ALL)"
    ", run AS (SELECT *, sum(n) OVER w AS cum_n, (sum(g) OVER w)::DOUBLE AS gl, (sum(h) OVER w)::DOUBLE AS hl, sum(n) OVER p AS tot_n, (sum(g) OVER p)::DOUBLE AS gt, (sum(h) OVER p)::DOUBLE AS ht FROM hist "
    "WINDOW w AS (PARTITION BY feature_id ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature_id))"
    ", scored AS (SELECT *, round(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)), 9) AS score FROM run WHERE tot_n > cum_n)"
)

#: Small graph of the vectors: groups are buckets of two dimensions.
GROUPS = "g AS (SELECT vec_id AS row_id, label, (floor(embedding[1] * 4)::INT) * 1000 + floor(embedding[2] * 4)::INT AS leaf FROM embeddings)"
EDGES = GROUPS + ", e AS (SELECT a.row_id AS src, b.row_id AS dst, 1.0::DOUBLE AS w FROM g a JOIN g b ON a.leaf = b.leaf AND a.row_id > b.row_id)"
BOTH = EDGES + ", s AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), comm AS (SELECT row_id AS node, label AS comm FROM g)"
