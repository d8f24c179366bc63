"""Growth that relabels every cell by its leaf Gaussian after each level and refreshes the leaves that changed.

Leaf statistics are sums (count, first and second moments around the root's mean), so they add and subtract: after a relabelling
only the cells that moved are summed, by (old leaf, new leaf). A closed leaf whose size changed by more than a tenth since it
was last scanned is opened again and queued for the next level; cells that no leaf claims with enough confidence belong to none
until the next relabelling asks again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.operators.assign import assign_to_leaves
from markertree.operators.profiles import PROFILES, Profile
from markertree.plans.tree import Tree
from markertree.session import bounded_rows, discard, materialize


@dataclass
class LeafSums:
    """Count, sum and outer-product sum of the markers around a fixed centre."""

    n: int
    first: np.ndarray
    second: np.ndarray

    def __add__(self, o: "LeafSums") -> "LeafSums":
        return LeafSums(self.n + o.n, self.first + o.first, self.second + o.second)

    def __sub__(self, o: "LeafSums") -> "LeafSums":
        return LeafSums(self.n - o.n, self.first - o.first, self.second - o.second)

    def mean(self, centre: np.ndarray) -> np.ndarray:
        return centre + self.first / max(self.n, 1)

    def cov(self, ddof: int = 1) -> np.ndarray:
        return (self.second - np.outer(self.first, self.first) / max(self.n, 1)) / max(self.n - ddof, 1)


@dataclass
class Refreshed:
    tree: Tree
    cells: DataFrame                   # the columns of the input and ``path``, null for cells that no leaf claims
    centre: np.ndarray
    sums: dict[str, LeafSums]          # of the leaves
    reopened: list[str]                # closed leaves that were queued again, in order


def leaf_sums(cells: DataFrame, by: list[str], markers: list[str], centre: np.ndarray) -> dict[tuple, LeafSums]:
    """Sums per group; one map-side combined job with group-sized result."""
    v = [F.col(m) - F.lit(float(c)) for m, c in zip(markers, centre)]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    rows = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(v)], *[
        F.sum(v[i] * v[j]).alias(f"q{i}_{j}") for i, j in pairs])
    out = {}
    for r in bounded_rows(rows):
        second = np.zeros((len(v), len(v)))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"q{i}_{j}"] or 0.0
        out[tuple(r[b] for b in by)] = LeafSums(r["n"], np.array([r[f"s{i}"] or 0.0 for i in range(len(v))]), second)
    return out


def moved(sums: dict[str, LeafSums], flows: dict[tuple, LeafSums]) -> dict[str, LeafSums]:
    """Leaf sums after cells flowed from leaf to leaf; None stands for no leaf."""
    out = dict(sums)
    for (old, new), part in flows.items():
        if old is not None and old in out:
            out[old] = out[old] - part
        if new is not None:
            out[new] = out[new] + part if new in out else part
    return out


def relabelled(cells: DataFrame, sums: dict[str, LeafSums], centre: np.ndarray, markers: list[str], confidence: float,
               drop_unsure: bool) -> DataFrame:
    """``cells`` (with ``_old``) and ``_base``, the most probable leaf of each; stored."""
    leaves = [{"leaf": p, "weight": float(s.n), "mean": s.mean(centre), "cov": s.cov()} for p, s in sorted(sums.items()) if s.n > 1]
    labelled = assign_to_leaves(cells, leaves, markers, confidence)
    label = F.col("leaf_label") if drop_unsure else F.coalesce("leaf_label", "_old")
    return materialize(labelled.withColumn("_base", label).drop("leaf_label", "leaf_probability"))


def grow_refreshed(cells: DataFrame, markers: list[str], profile: Profile | str = "marker", exclude: list[str] = (),
                   max_depth: int | None = None, tree: Tree | None = None, confidence: float = 0.85, moved_share: float = 0.1,
                   drop_unsure: bool = True, veto=None) -> Refreshed:
    """Grow with relabelling and refreshed leaves; null markers are not supported here (fill or filter them first).

    ``drop_unsure=False`` keeps unsure cells in the leaf that the split rules give. Ends when a level splits nothing: without a
    split nothing is relabelled, so no leaf changes.
    """
    from markertree.plans.grow import _apply_splits, _scan_level, gaussian_mean_ll

    p = PROFILES[profile] if isinstance(profile, str) else profile
    tree = tree or Tree()
    keep = [c for c in cells.columns if c not in markers]
    rows = cells.select(*keep, *markers)
    base = materialize(tree.assign(rows, "_base"))
    start = base.agg(*[F.avg(m).alias(m) for m in markers]).first()
    centre = np.array([start[m] if start[m] is not None else 0.0 for m in markers])
    sums = {path: s for (path,), s in leaf_sums(base, ["_base"], markers, centre).items()}
    total = sum(s.n for s in sums.values())
    scanned = {path: s.n for path, s in sums.items()}
    reopened: list[str] = []
    while tree.open_paths():
        scannable = []
        for path in tree.open_paths():
            node = tree.nodes[path]
            s = sums.get(path, LeafSums(0, np.zeros(len(markers)), np.zeros((len(markers),) * 2)))
            node.n, node.weight = int(s.n), s.n / max(total, 1)
            if s.n:
                ll, d = gaussian_mean_ll(s.cov(0)), len(markers)
                node.ll = node.weight * ll
                node.bic = float(-2 * s.n * ll + (d + d * (d + 1) / 2) * np.log(s.n))
            scanned[path] = s.n
            if s.n < p.min_cells:
                node.close("small size")
            elif max_depth is not None and len(path) >= max_depth:
                node.close("depth")
            else:
                scannable.append(path)
        if not scannable:
            break
        level = base.filter(F.col("_base").isin(scannable)).select(F.col("_base").alias("path"), *markers)
        records = _scan_level(level, markers, p, tree, exclude)
        _apply_splits(tree, scannable, records, p, veto, base, "_base")
        split = [q for q in scannable if tree.nodes[q].status == "split"]
        if not split:
            break
        placed = tree.assign(base, "_old", base="_base")
        children = leaf_sums(placed.filter(F.col("_base").isin(split)), ["_old"], markers, centre)
        for q in split:
            sums.pop(q, None)
        sums.update({path: s for (path,), s in children.items() if path is not None})
        following = relabelled(placed.drop("_base"), sums, centre, markers, confidence, drop_unsure)
        changed = following.filter(~F.col("_old").eqNullSafe(F.col("_base")))
        sums = moved(sums, leaf_sums(changed, ["_old", "_base"], markers, centre))
        discard(base)
        base = following.drop("_old")
        base._stored_at = following._stored_at
        for node in tree.leaves():
            size = sums[node.path].n if node.path in sums else 0
            if node.status == "leaf" and node.stop != "depth" and abs(size - scanned.get(node.path, size)) > moved_share * scanned[node.path]:
                node.status, node.stop, node.key = "open", None, []
                reopened.append(node.path)
            scanned.setdefault(node.path, size)
            node.n, node.weight = int(size), size / max(total, 1)
    return Refreshed(tree, base.withColumnRenamed("_base", "path"), centre, sums, reopened)
