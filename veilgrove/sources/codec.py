"""Text formats of experiments: training input, adjacency, communities, logs, and pictures of trees.

The training input is one file: ``K n m P``, then for each party its number of
columns and one line of values per column, then labels, the validation rows
alike without party counts, and their labels.  Missing values are -1 there.
"""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrove.frame import Feature, VerticalFrame


def _column_lines(frame: VerticalFrame) -> DataFrame:
    """feature_id, line: each feature's values in order of rows."""
    cells = frame.cells().select(frame.row_id, "feature_id", F.coalesce("x", F.lit(-1.0)).alias("x"))
    own = cells.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct(frame.row_id, "x"))).alias("v"))
    return own.select("feature_id", F.array_join(F.transform("v", lambda s: s["x"].cast("string")), " ").alias("line"))


def _labels(frame: VerticalFrame) -> str:
    got = frame.data.agg(F.array_sort(F.collect_list(F.struct(frame.row_id, frame.label))).alias("v")).select(F.array_join(F.transform("v", lambda s: s[frame.label].cast("string")), " ")).first()
    return got[0] or ""


def to_text(train: VerticalFrame, val: VerticalFrame) -> str:
    """The whole file.  The format holds a column in a line, so it is for experiments of that size."""
    lines = {r.feature_id: r.line for r in _column_lines(train).collect()}
    n, m = train.data.count(), val.data.count()
    parties = sorted({f.party_id for f in train.features})
    out = [f"{train.num_classes} {n} {len(train.features)} {len(parties)}"]
    for p in parties:
        own = [f for f in train.features if f.party_id == p]
        out += [str(len(own)), *[lines.get(f.feature_id, "") for f in own]]
    out += [_labels(train), str(m)]
    held = {r.feature_id: r.line for r in _column_lines(val).collect()}
    out += [held.get(f.feature_id, "") for f in train.features]
    return "\n".join([*out, _labels(val)]) + "\n"


def from_text(spark: SparkSession, text: str, missing: bool = False) -> tuple[VerticalFrame, VerticalFrame]:
    """Training and validation frames; -1 becomes null if ``missing``."""
    lines = text.split("\n")
    k, n, _, parties = map(int, lines[0].split())
    at, features, cols = 1, [], []
    for p in range(parties):
        for _ in range(int(lines[at])):
            at += 1
            features.append(Feature(len(features), p, f"f{len(features)}"))
            cols.append([float(v) for v in lines[at].split()])
        at += 1
    y = [int(float(v)) for v in lines[at].split()]
    m = int(lines[at + 1])
    held = [[float(v) for v in lines[at + 2 + c].split()] for c in range(len(features))]
    y2 = [int(float(v)) for v in lines[at + 2 + len(features)].split()]
    kind = "row_id long, y int, " + ", ".join(f"f{c} double" for c in range(len(features)))
    empty = lambda v: None if missing and v == -1 else v

    def build(values: list[list[float]], labels: list[int], size: int) -> VerticalFrame:
        rows = [(i, labels[i], *[empty(c[i]) for c in values]) for i in range(size)]
        return VerticalFrame(spark.createDataFrame(rows, kind), tuple(features), k)

    return build(cols, y, n), build(held, y2, m)


def read_text(spark: SparkSession, path: str, missing: bool = False) -> tuple[VerticalFrame, VerticalFrame]:
    return from_text(spark, spark.read.text(path, wholetext=True).first()[0], missing)


def adjacency_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, line: ``degree (neighbour weight)*`` over the stored triangle, a line for every node."""
    own = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("v"))
    text = F.concat_ws(" ", F.size("v").cast("string"), F.array_join(F.transform("v", lambda s: F.concat_ws(" ", s["dst"].cast("string"), s["w"].cast("string"))), " "))
    return nodes.select("node").join(own, "node", "left").select("node", F.coalesce(F.trim(F.when(F.col("v").isNotNull(), text)), F.lit("0")).alias("line"))


def adjacency_edges(lines: DataFrame) -> DataFrame:
    """src, dst, w from ``adjacency_lines``."""
    parts = lines.select("node", F.split(F.trim("line"), " +").alias("p")).where(F.size("p") > 1)
    pairs = parts.select("node", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))).alias("i"))
    return pairs.select(F.col("node").alias("src"), F.get("p", F.col("i")).cast("long").alias("dst"), F.get("p", F.col("i") + 1).cast("double").alias("w"))


def community_lines(comm: DataFrame) -> DataFrame:
    """comm, line: the rows of each community in order."""
    return comm.groupBy("comm").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), " ").alias("line"))


def community_rows(lines: DataFrame) -> DataFrame:
    return lines.select("comm", F.explode(F.split("line", " ").cast("array<bigint>")).alias("node")).select("node", "comm")


def union_line(roots: DataFrame) -> DataFrame:
    """line: the root of every row in order of rows, separated and ended by blanks, as the format wants it: one line."""
    return roots.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "root"))), lambda x: x["root"].cast("string")), " "), F.lit(" ")).alias("line"))


def union_rows(lines: DataFrame) -> DataFrame:
    """row_id (from 0), root from ``union_line``."""
    return lines.select(F.posexplode(F.split(F.trim("line"), " +").cast("array<bigint>")).alias("row_id", "root")).select(F.col("row_id").cast("long").alias("row_id"), "root")


def log_lines(log: DataFrame) -> DataFrame:
    """value: lines of a run's log, one for each round and figure that there is."""
    figures = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in ("loss", "purity", "offers", "leaves")])
    return log.select("round", F.explode(F.filter(figures, lambda x: x["v"].isNotNull())).alias("x")).select(F.format_string("round %d: %s: %s", "round", "x.k", "x.v").alias("value"))


def feature_scores(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, score from an array file of one number for each feature."""
    raw = spark.read.format("binaryFile").load(path).first().content
    scores = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(scores)], "feature_id int, score double")


def log_values(lines: DataFrame, name: str, col: str = "value") -> DataFrame:
    """round, value of lines such as ``round 3: <name>: 0.25``."""
    value = F.regexp_extract(F.col(col), rf"(?i){name}\s*[:=,]?\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    found = lines.select(F.regexp_extract(col, r"(?i)round\s+([0-9]+)", 1).alias("r"), value.alias("v")).where("v <> ''")
    return found.select(F.col("r").try_cast("int").alias("round"), F.col("v").try_cast("double").alias("value"))


def tree_text(model: object, tree: int, node: int = 1, depth: int = 0, purity: bool = False) -> str:
    """An indented picture of a tree; with ``purity``, leaves of one class are marked."""
    x = model.nodes[tree, node]
    pad = "  " * depth
    if x.leaf:
        mark = " *" if purity and x.n and max(x.counts, default=0) == x.n else ""
        return f"{pad}leaf n={x.n} value={[round(v, 4) for v in x.value]}{mark}\n"
    name = model.features[x.feature].name
    below = [tree_text(model, tree, 2 * node + s, depth + 1, purity) for s in (0, 1)]
    return f"{pad}party {x.party}: {name} <= {x.threshold:g} (n={x.n})\n" + "".join(below)


def tree_json(model: object, tree: int, node: int = 1) -> str:
    def build(k: int) -> dict:
        x = model.nodes[tree, k]
        if x.leaf:
            return {"name": "leaf", "n": x.n, "value": x.value}
        return {"name": model.features[x.feature].name, "party": x.party, "threshold": x.threshold, "n": x.n, "children": [build(2 * k), build(2 * k + 1)]}

    return json.dumps(build(node))


def report(trials: DataFrame, by: str = "metric", value: str = "value") -> DataFrame:
    """Mean and both deviations of every metric over trials."""
    from veilgrove.operators.metrics import mean_std

    return mean_std(trials, [by], [value])


def report_markdown(report: DataFrame) -> str:
    """A report, a row for each metric, as a table in text."""
    rows = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in report.orderBy(report.columns[0]).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [report.columns, ["-"] * len(report.columns), *rows]) + "\n"


def report_csv(report: DataFrame, path: str) -> None:
    """The same as one file with a header."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)
