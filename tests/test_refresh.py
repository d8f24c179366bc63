"""Relabelling with refreshed leaves: carried statistics, a leaf that must be split again, dropped cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markertree.functions.stats import hashed_normal
from markertree.plans.grow import grow
from markertree.plans.refresh import LeafSums, grow_refreshed, leaf_sums, moved
from markertree.plans.tree import Tree, interval_rule

MARKERS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cells(spark):
    """1,500 cells low in a (b tells two types), 4,000 high in a; c and _start put 300 of the low ones on the wrong side."""
    low = F.col("id") < 1500
    return spark.range(0, 5500, 1, 4).select(
        F.col("id").cast("string").alias("cell_id"),
        (F.when(low, -3.0).otherwise(3.0) + hashed_normal(1, "id") * 0.5).alias("a"),
        (F.when(low & (F.col("id") % 2 == 0), -4.0).when(low, 4.0).otherwise(0.0) + hashed_normal(2, "id")).alias("b"),
        (F.when(F.col("id") < 1200, -1.0).otherwise(1.0) + hashed_normal(3, "id") * 0.01).alias("c"),
        F.when(F.col("id") < 1200, -1.0).otherwise(1.0).alias("_start")).persist()


def start() -> Tree:
    tree = Tree()
    tree.split("", interval_rule("c", [0.0], "L"))
    tree.nodes["L"].close("small size")
    return tree


def test_a_grown_leaf_is_split_again(cells):
    plain = grow(cells.select("cell_id", "a", "b", "_start"), ["a", "b"], tree=_without_c())
    out = grow_refreshed(cells.select("cell_id", "a", "b", "_start"), ["a", "b"], tree=_without_c())
    assert plain.nodes["L"].status == "leaf"
    assert out.reopened[0] == "L" and out.tree.nodes["L"].status == "split" and out.tree.nodes["L"].key == ["b"]


def _without_c() -> Tree:
    """L holds 1,200 low cells by a rule on a column that is no marker; the other 300 sit in R."""
    tree = Tree()
    tree.split("", interval_rule("_start", [0.0], "L"))
    tree.nodes["L"].close("small size")
    return tree


def test_carried_sums_equal_a_recomputation(spark, cells):
    out = grow_refreshed(cells, MARKERS, tree=start())
    again = leaf_sums(out.cells.filter("path is not null"), ["path"], MARKERS, out.centre)
    assert {p for p, s in out.sums.items() if s.n} == {p for (p,) in again}
    for (p,), s in again.items():
        assert out.sums[p].n == s.n
        assert np.allclose(out.sums[p].first, s.first) and np.allclose(out.sums[p].second, s.second)
    assert all(n.n == out.sums[n.path].n for n in out.tree.leaves() if n.path in out.sums)


def test_unsure_cells_belong_to_no_leaf(spark):
    near = spark.range(0, 4000, 1, 2).select(F.col("id").cast("string").alias("cell_id"), (
        F.when(F.col("id") % 2 == 0, -3.0).otherwise(3.0) + hashed_normal(1, "id")).alias("a"))
    dropped = grow_refreshed(near, ["a"], confidence=0.99)
    kept = grow_refreshed(near, ["a"], confidence=0.99, drop_unsure=False)
    assert dropped.cells.filter("path is null").count() > 0 and kept.cells.filter("path is null").count() == 0
    assert dropped.cells.count() == kept.cells.count() == 4000
    assert sum(s.n for s in dropped.sums.values()) == dropped.cells.filter("path is not null").count()


def test_flows_between_leaves():
    s = lambda n: LeafSums(n, np.array([float(n)]), np.array([[2.0 * n]]))
    out = moved({"L": s(10), "R": s(4)}, {("L", "R"): s(3), ("R", None): s(1), (None, "L"): s(2)})
    assert (out["L"].n, out["R"].n) == (9, 6) and out["R"].first[0] == 6.0
