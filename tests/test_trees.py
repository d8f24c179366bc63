"""Growing, resuming, pruning and coding trees on planted data."""

import pytest
from planted import four_types
from pyspark.sql import functions as F

from markertree.operators import evaluate as E
from markertree.operators import treetables as T
from markertree.operators.profiles import PROFILES
from markertree.operators.scan import group_limits, scan_markers, scan_pairs
from markertree.plans.grow import grow, reopen
from markertree.plans.tree import Tree, interval_rule

MARKERS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cells(spark):
    return four_types(spark).persist()


@pytest.fixture(scope="module")
def tree(cells):
    return grow(cells, MARKERS, "marker")


def rand(cells, tree):
    return E.rand_indices(E.contingency(tree.assign(cells), "truth", "path")).first()["adjusted_rand"]


def test_planted_tree_is_found(cells, tree):
    assert [n.path for n in tree.leaves()] == ["LL", "LR", "RL", "RR"]
    assert tree.nodes[""].key == ["a"] and tree.nodes["L"].key == ["c"] and tree.nodes["R"].key == ["b"]
    assert rand(cells, tree) > 0.95


def test_children_partition_the_parent(cells, tree):
    counts = {r["path"]: r["n"] for r in tree.assign(cells).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == cells.count()
    assert all(tree.nodes[p].n == n for p, n in counts.items())
    assert tree.nodes["L"].n + tree.nodes["R"].n == tree.nodes[""].n


def test_result_does_not_depend_on_partitioning(spark, tree):
    again = grow(four_types(spark, partitions=1), MARKERS, "marker")
    assert [(n.path, n.key, n.stop, n.n) for n in again.nodes.values()] == [(n.path, n.key, n.stop, n.n) for n in tree.nodes.values()]


def test_store_and_resume(spark, cells, tree):
    first = grow(cells, MARKERS, "marker", max_depth=1)
    stored = Tree.from_frame(first.to_frame(spark))
    assert {n.stop for n in stored.leaves()} == {"depth"}
    resumed = grow(cells, MARKERS, "marker", tree=reopen(stored, ["depth"]))
    assert sorted(resumed.nodes) == sorted(tree.nodes)


def test_reassignment_keeps_the_types(cells):
    t = grow(cells, MARKERS, "marker", reassign=True)
    assert len(t.leaves()) == 4


def test_tree_beats_one_gaussian(tree):
    assert tree.total_ll() > tree.nodes[""].ll


def test_veto_can_reject(cells):
    t = grow(cells, MARKERS, "marker", veto=lambda proposals, placed: set())
    assert t.nodes[""].stop == "rejected by expression"


def test_prune(tree):
    copy = Tree({p: n for p, n in tree.nodes.items()})
    copy.cut_at("L")
    assert "LL" not in copy.nodes and copy.nodes["L"].status == "leaf"
    tree.split("L", interval_rule("c", [0.05], "L")) if "LL" not in tree.nodes else None


def test_stop_reasons(spark):
    few = spark.range(50).select(F.col("id").cast("double").alias("a"))
    assert grow(few, ["a"], "marker").nodes[""].stop == "small size"
    flat = spark.range(2000).select((F.col("id") % 4).cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert grow(flat, ["a", "b"], "marker").nodes[""].stop == "no separable features"


def test_skewed_unimodal_marker_is_merged(spark):
    from markertree.functions.stats import hashed_normal

    df = spark.range(4000).select(F.lit("x").alias("g"), F.exp(hashed_normal(4, "id") * 0.4).alias("v"))
    p = PROFILES["marker"].with_options(dip_slope=None)
    r = scan_markers(df, ["g"], ["v"], group_limits(df, ["g"], ["v"]), p).first()
    assert r["k_merged"] == 1


def test_pair_separates_where_singles_fail(spark):
    from markertree.functions.stats import hashed_normal

    side = F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    u = hashed_normal(1, "id") * 3
    df = spark.range(6000).select(F.lit("x").alias("g"), (u + side * 1.2 + hashed_normal(2, "id") * 0.2).alias("p"),
                                  (u - side * 1.2 + hashed_normal(3, "id") * 0.2).alias("q"))
    limits = group_limits(df, ["g"], ["p", "q"])
    p = PROFILES["consensus"].with_options(max_k=4)
    singles = scan_markers(df, ["g"], ["p", "q"], limits, p).collect()
    pair = scan_pairs(df, ["g"], [("x", "p", "q")], limits, p).first()
    assert not any(r["separable"] for r in singles) and pair["separable"] and pair["k_merged"] == 2


def test_hot_value_does_not_break_the_scan(spark):
    """A third of all rows share one value."""
    from markertree.functions.stats import hashed_normal

    df = spark.range(9000).select(F.lit("x").alias("g"), F.when(F.col("id") % 3 == 0, -4.0).otherwise(4 + hashed_normal(1, "id")).alias("v"))
    r = scan_markers(df, ["g"], ["v"], group_limits(df, ["g"], ["v"]), PROFILES["marker"].with_options(low_similarity=None)).first()
    assert r["n"] == 9000 and r["separable"] and r["n_chosen"] in (3000, 6000)


def test_splice_moves_the_sibling_up():
    # root 0 with children 1, 2; 2 has children 5, 6; removing 5 puts 6 in the place of 2
    new = T.remap_after_removal([0, 1, 2, 5, 6, 13, 14], [5])
    assert new == {0: 0, 1: 1, 2: None, 5: None, 6: 2, 13: 5, 14: 6}


def test_resumed_weights_are_shares_of_the_root(cells):
    first = grow(cells, MARKERS, "marker", max_depth=1)
    first.nodes["R"].status = "open"
    again = grow(cells, MARKERS, "marker", tree=first, max_depth=1)
    assert again.nodes["R"].weight == pytest.approx(again.nodes["R"].n / again.nodes[""].n)
    assert again.nodes["R"].weight < 1
