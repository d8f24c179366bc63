"""Consensus growth, votes and post-passes on planted batches."""

import numpy as np
import pytest
from planted import three_batches
from pyspark.sql import functions as F

from markertree.operators import linear as L
from markertree.operators import votes as V
from markertree.plans import postpass as PP
from markertree.plans.consensus import grow_consensus, leaf_table, pack_expression


@pytest.fixture(scope="module")
def data(spark):
    cells, long = three_batches(spark)
    return cells.persist(), long.persist()


def test_consensus_tree_and_transfer(data):
    cells, long = data
    tree = grow_consensus(cells.drop("t"), ["m1", "m2", "m3"], long, child_cutoff=0.1)
    assert tree.model.nodes[""].key == ["m2"]
    assert [n.path for n in tree.model.leaves()] == ["LL", "LR", "RL", "RR"]
    assert tree.batches["b2"].nodes["L"].key == ["artificial"] and tree.batches["b0"].nodes["L"].key == ["m1"]
    placed = leaf_table(pack_expression(cells.drop("t"), long)[0], tree).join(cells.select("cell_id", "t"), "cell_id")
    want = F.concat(F.when(F.col("t") % 2 == 1, "R").otherwise("L"), F.when(F.col("t") >= 2, "R").otherwise("L"))
    right = {r["batch"]: r["ok"] for r in placed.groupBy("batch").agg(F.avg((F.col("path") == want).cast("double")).alias("ok")).collect()}
    assert min(right.values()) > 0.95


def test_zero_child_cutoff_stops_below_the_root(data):
    cells, long = data
    tree = grow_consensus(cells.drop("t"), ["m1", "m2", "m3"], long, child_cutoff=0.0)
    assert sorted(tree.model.nodes) == ["", "L", "R"]


def test_single_candidate_is_handicapped(spark):
    s = spark.createDataFrame([("n", 0, ["a"], 2.0), ("n", 1, ["a"], 1.0)], "node string, batch_ord int, key array<string>, score double")
    assert V.marker_votes(s).first()["vote"] == pytest.approx(-10 + 0.2)


def test_shared_direction_prefers_the_common_gap():
    within = np.diag([1.0, 1.0, 1.0])
    w = V.shared_direction(within, [np.array([2.0, 3.0, 0.0]), np.array([2.0, -3.0, 0.0])], ridge=0.0, align=1.0)
    assert abs(w[0]) > 0.99 and np.linalg.norm(w) == pytest.approx(1.0)


def test_retrain_recovers_sides(spark, data):
    cells, long = data
    features = [f"g{i}" for i in range(30)]
    rows = L.pack_rows(long, cells.select("batch", "cell_id", "t", "m2").withColumn("side", F.when(F.col("m2") > 0, "R").otherwise("L")), features, ["batch", "cell_id"])
    out = PP.refresh_level(rows, 30, ["m2"], ["retrain"])
    ok = out.agg(F.avg(((F.col("side") == "R") == (F.col("t") % 2 == 1)).cast("double"))).first()[0]
    assert ok > 0.93


def test_mixture_split_only_for_two_components(spark):
    from markertree.functions.stats import hashed_normal

    two = F.when(F.col("id") % 2 == 0, -4.0).otherwise(4.0)
    h = spark.range(4000).select(F.when(F.col("id") < 2000, "two").otherwise("one").alias("batch"),
                                 (F.when(F.col("id") < 2000, two).otherwise(0.0) + hashed_normal(3, "id")).alias("h"), "id")
    out = PP.split_projection_by_mixture(h, ["batch"])
    per = {r["batch"]: r["n"] for r in out.groupBy("batch").agg(F.count("side").alias("n")).collect()}
    assert per == {"two": 2000, "one": 0}


def test_documents_are_packed_once(spark, sf, monkeypatch):
    from markertree.plans import consensus as C
    from markertree.plans import queries_models as Q

    calls = []
    once = lambda *a: calls.append(1) or pack_expression(*a)
    monkeypatch.setattr(C, "pack_expression", once)
    monkeypatch.setattr(Q, "pack_expression", once)
    assert Q.consensus_leaf_cells(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(calls) == 1


def test_rules_read_rows_without_python_objects(spark):
    cells, long = three_batches(spark)
    tree = grow_consensus(cells.drop("t"), ["m1", "m2", "m3"], long, child_cutoff=0.1)
    plan = leaf_table(pack_expression(cells.drop("t"), long)[0], tree)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
