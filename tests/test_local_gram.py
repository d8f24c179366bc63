"""Grouped local Grams against numpy, and growth whose number of jobs does not depend on the nodes."""

import numpy as np
import pandas as pd
import pytest
from planted import four_types, three_batches
from pyspark.sql import functions as F

from markertree.functions.stats import hashed_normal
from markertree.operators import local_gram as G
from markertree.plans import expression as X
from markertree.plans.consensus import feature_dictionary, grow_consensus, pack_expression
from markertree.plans.grow import grow
from markertree.plans.tree import interval_rule


def test_moments_of_every_node_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows, dense, sizes = [], {}, {}
    for node, width in (("", 3), ("L", 70), ("LR", 1)):
        x = rng.standard_normal((700, width)) * (rng.random((700, width)) < 0.3)
        part = np.array(["0L", "0R", "1L"])[rng.integers(0, 3, 700)]
        dense[node] = (x, part)
        sizes[node] = {p: int((part == p).sum()) for p in set(part)}
        rows += [(node, part[c], f"c{c}", 10 * j, float(x[c, j])) for c in range(700) for j in range(width) if x[c, j]]
    entries = spark.createDataFrame(rows, "node string, part string, cell string, i long, v double").repartition(5)
    index = G.node_features(entries.select("node", "i"))

    def solve(node, raw, sums):
        return pd.DataFrame([(node, raw.ravel(), {p: (float(n), float(s.sum())) for p, (n, s) in sums.items()})], columns=["node", "raw", "sums"])

    found = G.solve_nodes(entries, index, sizes, solve, "node string, raw array<double>, sums map<string,struct<n:double,s:double>>")
    for r in found.collect():
        x, part = dense[r["node"]]
        assert np.allclose(np.reshape(r["raw"], (x.shape[1],) * 2), x.T @ x)
        for p in set(part):
            assert r["sums"][p]["n"] == (part == p).sum() and r["sums"][p]["s"] == pytest.approx(x[part == p].sum())


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    spark.sparkContext.setJobGroup("after", "after")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_veto_in_a_fixed_number_of_jobs(spark):
    """Six nodes, each split by a marker; expression follows the split in the first three only."""
    cells = spark.range(0, 6000, 1, 4).select(
        F.col("id").cast("string").alias("cell_id"), F.concat(F.lit("n"), (F.col("id") % 6).cast("string")).alias("path"),
        (F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, -3.0).otherwise(3.0) + hashed_normal(1, "id")).alias("a")).persist()
    follows = (F.substring("path", 2, 1).cast("int") < 3) & (F.col("a") > 0)
    long = cells.select("cell_id", "path", "a", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("g")).select(
        "cell_id", F.concat(F.lit("g"), F.col("g").cast("string")).alias("feature"),
        (F.when(follows & (F.col("g") < 10), 3.0).otherwise(0.0) + F.abs(hashed_normal(2, "cell_id", "g"))).alias("value")).persist()
    rule = interval_rule("a", [0.0], "L")
    veto = X.expression_veto(long)
    one, jobs_one = jobs_of(spark, "one", lambda: veto([("n0", None, rule)], cells))
    six, jobs_six = jobs_of(spark, "six", lambda: veto([(f"n{i}", None, rule) for i in range(6)], cells))
    assert one == {0} and six == {0, 1, 2}
    assert jobs_six <= jobs_one + 2  # adaptive plans differ by a stage or two


def test_a_side_without_cells_is_not_accepted(spark):
    cells = spark.createDataFrame([("1", "n", 1.0), ("2", "n", 2.0)], "cell_id string, path string, a double")
    long = spark.createDataFrame([("1", "f", 1.0), ("2", "f", 1.0)], "cell_id string, feature string, value double")
    assert X.expression_veto(long)([("n", None, interval_rule("a", [0.0], "L"))], cells) == set()


def test_a_veto_sends_the_cells_of_its_proposals_to_the_entries(spark, monkeypatch):
    """Above the session's broadcast threshold too, the many entries are neither shuffled nor sorted to find their cells."""
    cells = spark.range(400).select(F.col("id").cast("string").alias("cell_id"), F.lit("n").alias("path"), (F.col("id") - 199.5).alias("a"))
    long = cells.select("cell_id", F.lit("f").alias("feature"), F.when(F.col("a") > 0, 3.0 + F.abs("a") / 100).otherwise(F.abs("a") / 100).alias("value"))
    plans, keep = {}, X.materialize
    monkeypatch.setattr(X, "materialize", lambda df: plans.update({tuple(df.columns): df._jdf.queryExecution().executedPlan().toString()}) or keep(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert X.expression_veto(X.materialize(long))([("n", None, interval_rule("a", [0.0], "L"))], cells) == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    entries = plans["cell", "i", "v", "node", "side"]
    assert "BroadcastHashJoin" in entries and "SortMergeJoin" not in entries


def test_growth_under_a_veto(spark):
    cells = four_types(spark, 6000)
    high = F.col("truth") >= 2
    long = cells.select("cell_id", "truth", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("g")).select(
        "cell_id", F.col("g").cast("string").alias("feature"),
        (F.when(high & (F.col("g") < 5), 3.0).otherwise(0.0) + F.abs(hashed_normal(4, "cell_id", "g"))).alias("value"))
    tree = grow(cells, ["a", "b", "c"], veto=X.expression_veto(long.persist()), store=True)
    assert tree.nodes[""].key == ["a"] and sorted(tree.nodes) == ["", "L", "R"]  # b and c have no expression behind them
    assert {n.stop for n in tree.leaves()} == {"rejected by expression"}


def test_more_than_200_000_features(spark):
    cells, long = three_batches(spark, 1500)
    noise = cells.select("batch", "cell_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("n")).select(
        "batch", "cell_id", F.concat_ws("-", F.lit("noise"), "cell_id", "n").alias("feature"), F.lit(0.1).alias("value"))
    wide = long.unionByName(noise).persist()
    _, features = pack_expression(cells, wide)
    assert features.count() > 200_000
    tree = grow_consensus(cells.drop("t"), ["m1", "m2", "m3"], wide, child_cutoff=0.1)
    assert [n.path for n in tree.model.leaves()] == ["LL", "LR", "RL", "RR"]
    assert tree.weights_frame(spark).filter("feature like 'noise%'").count() == 0  # no batch shares them
    assert feature_dictionary(wide).filter("batches = 3").count() == 30


def test_packed_moments_equal_numpy(spark):
    """Rows with repeated, unselected and no entries; a node over several tasks."""
    rng = np.random.default_rng(5)
    rows, dense, sizes = [], {}, {}
    for node, width in (("L", 40), ("R", 3)):
        x, part = np.zeros((900, width)), np.array(["0L", "0R"])[rng.integers(0, 2, 900)]
        for c in range(900):
            j = rng.integers(0, width, c % 7)
            v = rng.standard_normal(len(j))
            np.add.at(x[c], j, v)
            rows.append((node, str(part[c]), c, [int(k) * 5 for k in j] + [7], [*map(float, v), 9.0]))
        dense[node] = (x, part)
        sizes[node] = {p: int((part == p).sum()) for p in ("0L", "0R")}
    packed = spark.createDataFrame(rows, "node string, part string, cell long, idx array<long>, val array<double>").repartition(5)
    index = G.node_features(packed.select("node", F.explode("idx").alias("i")).filter("i <> 7"))

    def solve(node, raw, sums):
        return pd.DataFrame([(node, raw.ravel(), {p: (float(n), float(s.sum())) for p, (n, s) in sums.items()})], columns=["node", "raw", "sums"])

    schema = "node string, raw array<double>, sums map<string,struct<n:double,s:double>>"
    held, G.ROWS_PER_SALT = G.ROWS_PER_SALT, 200
    try:
        solution = G.solve_packed(packed, ["cell"], index, sizes, solve, schema)
        plan = solution._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "Generate" not in plan  # tasks are not joined by bytes, cells move whole
        found = {r["node"]: r for r in solution.collect()}
    finally:
        G.ROWS_PER_SALT = held
    for node, (x, part) in dense.items():
        assert np.allclose(np.reshape(found[node]["raw"], (x.shape[1],) * 2), x.T @ x)
        for p in set(part):
            assert found[node]["sums"][p]["s"] == pytest.approx(x[part == p].sum())
