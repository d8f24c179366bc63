"""A grown tree: node records, split rules, and its compilation into one Column expression.

A split is a rule over marker values, so a cell's node is a function of its row. Growing never stores or
shuffles cell assignments: each level reads the table and evaluates the tree so far.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markertree.sources.schema import NODES


@dataclass
class Node:
    path: str
    n: int = 0
    weight: float = 1.0
    key: list[str] = field(default_factory=list)
    status: str = "open"          # open | split | leaf
    stop: str | None = None
    ll: float | None = None
    bic: float | None = None
    score: float | None = None
    dominant: str | None = None
    n_left: int | None = None
    n_right: int | None = None
    mean_left: list[float] | None = None
    mean_right: list[float] | None = None
    rule: dict | None = None
    scores: dict[str, float] = field(default_factory=dict)

    def close(self, reason: str) -> None:
        self.status, self.stop, self.key, self.rule = "leaf", reason, ["leaf"], None


def interval_rule(marker: str, cuts: list[float], starts: str) -> dict:
    """Sides alternate at each cut, beginning with ``starts`` below the first."""
    return {"kind": "intervals", "marker": marker, "cuts": [float(c) for c in cuts], "starts": starts}


def mixture_rule(markers: list[str], weights, means, covs, merged, chosen: int, side: str) -> dict:
    """Cells whose most probable merged class is ``chosen`` go to ``side``, all others across."""
    return {"kind": "mixture", "markers": list(markers), "weights": list(weights), "means": list(means), "covs": list(covs),
            "merged": list(merged), "chosen": int(chosen), "side": side}


def band_rule(column: str, low: float, high: float) -> dict:
    """Below ``low`` left, above ``high`` right, neither in between (both ends open)."""
    return {"kind": "band", "marker": column, "cuts": [float(low), float(high)]}


def other(side: str) -> str:
    return "R" if side == "L" else "L"


def side_column(rule: dict, value=None) -> Column:
    """'L', 'R' or null (value missing, or inside the band)."""
    value = value or (lambda m: F.col(f"`{m}`"))
    if rule["kind"] == "band":
        v = value(rule["marker"])
        low, high = rule["cuts"]
        return F.when(v < low, "L").when(v > high, "R")
    if rule["kind"] == "intervals":
        v = value(rule["marker"])
        side, out = rule["starts"], None
        for cut in rule["cuts"]:
            cond = v <= F.lit(cut)
            out = F.when(cond, side) if out is None else out.when(cond, side)
            side = other(side)
        last = F.when(v.isNotNull(), F.lit(side))
        return out.otherwise(last) if out is not None else last
    markers = rule["markers"]
    d, k = len(markers), len(rule["weights"])
    means = np.asarray(rule["means"]).reshape(k, d)
    covs = np.asarray(rule["covs"]).reshape(k, d, d)
    logs = []
    for w, m, c in zip(rule["weights"], means, covs):
        inverse = np.linalg.inv(c)
        quad: Column = F.lit(float(np.log(max(w, 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + np.log(np.linalg.det(c)))))
        gaps = [value(name) - F.lit(float(mu)) for name, mu in zip(markers, m)]
        for i in range(d):
            quad = quad - F.lit(0.5 * float(inverse[i, i])) * gaps[i] * gaps[i]
            for j in range(i + 1, d):
                quad = quad - F.lit(float(inverse[i, j])) * gaps[i] * gaps[j]
        logs.append(quad)
    top = F.greatest(*logs) if k > 1 else logs[0]
    sums: dict[int, Column] = {}
    for log, label in zip(logs, rule["merged"]):
        e = F.exp(log - top)
        sums[label] = sums[label] + e if label in sums else e
    mine = sums[rule["chosen"]]
    beats = F.lit(True)
    for label, total in sums.items():
        if label != rule["chosen"]:
            beats = beats & ((mine >= total) if rule["chosen"] < label else (mine > total))
    known = value(markers[0]).isNotNull()
    for m in markers[1:]:
        known = known & value(m).isNotNull()
    return F.when(known, F.when(beats, rule["side"]).otherwise(other(rule["side"])))


class Tree:
    """Nodes by path ('' is the root, then L/R letters)."""

    def __init__(self, nodes: dict[str, Node] | None = None, batch: str | None = None):
        self.nodes = nodes if nodes is not None else {"": Node("")}
        self.batch = batch

    # -- structure
    def open_paths(self) -> list[str]:
        return sorted(p for p, n in self.nodes.items() if n.status == "open")

    def leaves(self) -> list[Node]:
        return [self.nodes[p] for p in sorted(self.nodes) if self.nodes[p].status != "split"]

    def split(self, path: str, rule: dict) -> None:
        node = self.nodes[path]
        node.status, node.rule = "split", rule
        for side in "LR":
            self.nodes[path + side] = Node(path + side)

    def cut_at(self, path: str) -> None:
        """Prune: the node becomes a leaf, everything below goes."""
        for p in [p for p in self.nodes if p.startswith(path) and p != path]:
            del self.nodes[p]
        self.nodes[path].close("cut")

    def total_ll(self) -> float:
        return sum(n.ll or 0.0 for n in self.leaves())

    # -- compilation
    def path_column(self, start: str = "", only_open: bool = False, value=None) -> Column:
        """Node path of each row. ``only_open`` gives null for rows in closed leaves."""

        def build(path: str) -> Column:
            node = self.nodes[path]
            here = F.lit(None).cast("string") if only_open and node.status != "open" else F.lit(path)
            if node.status != "split":
                return here
            side = side_column(node.rule, value)
            stay = F.lit(None).cast("string") if only_open else F.lit(path)
            return F.when(side == "L", build(path + "L")).when(side == "R", build(path + "R")).otherwise(stay)

        return build(start)

    def assign(self, cells: DataFrame, column: str = "path", only_open: bool = False, base: str | None = None) -> DataFrame:
        """Add the node path. ``base`` names a column with the path to start from (resumed or relabelled trees)."""
        if base is None:
            return cells.withColumn(column, self.path_column(only_open=only_open))
        expr: Column | None = None
        for p in sorted(self.nodes):
            if only_open and self.nodes[p].status == "leaf":
                continue
            cond, sub = F.col(base) == p, self.path_column(p, only_open)
            expr = F.when(cond, sub) if expr is None else expr.when(cond, sub)
        return cells.withColumn(column, expr if expr is not None else F.lit(None).cast("string"))

    # -- tables
    def to_rows(self) -> list[tuple]:
        rows = []
        for p in sorted(self.nodes, key=lambda q: (len(q), q)):
            n = self.nodes[p]
            rows.append((
                self.batch, p, len(p), list(n.key), n.status, n.stop, n.n, n.weight, n.ll, n.bic, n.score, n.dominant,
                n.n_left, n.n_right, n.mean_left, n.mean_right, json.dumps(n.rule) if n.rule else None, dict(n.scores),
            ))
        return rows

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), NODES)

    @classmethod
    def from_rows(cls, rows) -> "Tree":
        """Rebuild a tree from node rows (as ``to_rows`` gives them, or collected ones)."""
        out, batch = {}, None
        for row in rows:
            r = dict(zip(NODES.fieldNames(), row))
            batch = r["batch"]
            out[r["path"]] = Node(
                path=r["path"], n=r["n"], weight=r["weight"], key=list(r["key"] or []), status=r["status"], stop=r["stop"],
                ll=r["ll"], bic=r["bic"], score=r["score"], dominant=r["dominant"], n_left=r["n_left"], n_right=r["n_right"],
                mean_left=r["mean_left"], mean_right=r["mean_right"], rule=json.loads(r["rule"]) if r["rule"] else None,
                scores=dict(r["scores"] or {}),
            )
        return cls(out, batch)

    @classmethod
    def from_frame(cls, nodes: DataFrame) -> "Tree":
        """Rebuild a tree from its stored node table (node-sized)."""
        from markertree.session import bounded_rows

        return cls.from_rows(bounded_rows(nodes.select(*NODES.fieldNames())))


def rule_from_record(record, dims: int) -> tuple[dict, str]:
    """Split rule of a scan record and the side of the chosen cluster.

    One marker: the higher mean goes right. Two: the larger cosine to the diagonal.
    """
    from markertree.operators.knots import cut_points

    chosen_mean, rest_mean = record["mean_chosen"], record["mean_rest"]
    if dims == 1:
        side = "R" if chosen_mean[0] > rest_mean[0] else "L"
        k = len(record["weights"])
        cuts, inside = cut_points(
            record["weights"], np.reshape(record["means"], (k, 1)), np.reshape(record["covs"], (k, 1, 1)), record["merged"],
            record["chosen"], record["low"], record["high"])
        return interval_rule(record["key"][0], cuts, side if inside else other(side)), side
    cosine = lambda m: sum(m) / max(float(np.sqrt(sum(v * v for v in m))), 1e-300)
    side = "R" if cosine(chosen_mean) > cosine(rest_mean) else "L"
    return mixture_rule(record["key"], record["weights"], record["means"], record["covs"], record["merged"], record["chosen"], side), side
