"""Edge cases of normalisation, quality control, quantiles, features, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markertree.operators import features as FE
from markertree.operators import normalize as N
from markertree.operators import qc as Q
from markertree.operators import select as S
from markertree.operators.quantiles import exact_quantiles
from markertree.sources import readers as R
from markertree.sources import writers as W


def test_quantiles_with_hot_value(spark):
    df = spark.range(0, 3001, 1, 6).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.sqrt("id")).alias("v"))
    v = np.array([r["v"] for r in df.collect()])
    got = exact_quantiles(df, [], "v", [0.0, 0.1, 0.25, 0.5, 0.99, 1.0], bins=64).first()
    assert np.allclose([got[f"q{i}"] for i in range(6)], np.quantile(v, [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]))


def test_quantiles_constant_group(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 1.0), ("b", 3.0)], "g string, v double")
    assert {r["g"]: r["q0"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {"a": 2.0, "b": 2.0}


def test_outlier_fallback_and_flag(spark):
    rows = [(i, float(i % 10)) for i in range(500)] + [(1000 + i, 1000.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double")
    few = Q.iqr_outliers(df, "id", ["v"], factor=3.0, max_drop=100)
    assert few["flagged"] and few["cells"].count() == 500
    many = Q.iqr_outliers(df, "id", ["v"], factor=3.0, max_drop=30)
    assert many["cells"].count() == len(rows) - 2


def test_jitter_is_reproducible_and_small(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("cell_id"), F.lit("f").alias("feature"), F.lit(1.0).alias("value"))
    a = N.jitter(df, seed=3).agg(F.sum("value"), F.stddev("value")).first()
    b = N.jitter(df.repartition(7), seed=3).agg(F.sum("value"), F.stddev("value")).first()
    assert a[0] == pytest.approx(b[0]) and 0.008 < a[1] < 0.012


def test_welch_counts_absent_entries_as_zero(spark):
    long = spark.createDataFrame([("1", "f", 2.0), ("2", "f", 4.0), ("4", "g", 1.0)], "cell_id string, feature string, value double")
    groups = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", "y"), ("5", "y")], "cell_id string, group string")
    s = {(r["feature"], r["group"]): r["score"] for r in FE.welch_scores(long, groups).collect()}
    x, y = np.array([2.0, 4.0]), np.zeros(3)
    assert s[("f", "x")] == pytest.approx((x.mean() - y.mean()) / np.sqrt(x.var(ddof=1) / 2 + y.var(ddof=1) / 3))
    assert s[("g", "x")] < 0 < s[("g", "y")]


def test_unique_names_and_readers(spark, tmp_path):
    assert R.deduplicated(["a", "b", "a", "a"]) == ["a", "b", "a-1", "a-2"]
    path = str(tmp_path / "m")
    spark.createDataFrame([("c1", 1.5, 2.0), ("c2", None, 3.0)], "id string, CD3 double, CD4 double").coalesce(1).write.option("header", True).csv(path)
    df = R.read_marker_table(spark, path)
    assert df.columns == ["cell_id", "CD3", "CD4"] and df.filter("CD3 is null").count() == 1


def test_append_records_unions_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    W.append_records(spark, spark.createDataFrame([(1.0, "a")], "time double, method string"), path)
    out = W.append_records(spark, spark.createDataFrame([(2.0, "b", 3.0)], "time double, method string, bic double"), path)
    assert out.count() == 2 and "bic" in out.columns


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = S.top_per_group(df, ["g"], [F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark, sf):
    from markertree.sources.tables import line_cells

    plan = line_cells(spark, sf).filter("batch = 'R'").select("qty")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_tax" not in plan.split("ReadSchema")[1]


def test_streamed_paths_equal_batch(spark, tmp_path):
    from markertree.plans.tree import Tree, band_rule, interval_rule
    from markertree.streaming import scorer

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    cells = spark.range(0, 300, 1, 3).select("id", (F.col("id") % 17).cast("double").alias("m"), (F.col("id") % 5).cast("double").alias("h"))
    cells.write.parquet(source)
    tree = Tree()
    tree.split("", interval_rule("m", [3.0, 9.0], "R"))
    tree.split("L", band_rule("h", 1.0, 3.0))
    scorer.run_to_table(scorer.score_cells(scorer.read_cells(spark, source, cells.schema, 1), tree), sink, str(tmp_path / "state"))
    streamed = {(r["id"], r["path"]) for r in spark.read.parquet(sink).collect()}
    assert streamed == {(r["id"], r["path"]) for r in tree.assign(cells).collect()}
    assert {p for _, p in streamed} == {"R", "L", "LL", "LR"}
