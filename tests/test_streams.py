"""Streams against stored trees and event-time windows that close."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from markertree.plans.consensus import ConsensusTree
from markertree.plans.tree import Tree
from markertree.streaming import scorer

PACKED = "batch string, cell_id string, idx array<long>, val array<double>"


def projection(ids, w, low, high):
    return {"kind": "projection", "idx": ids, "w": w, "cuts": [low, high]}


@pytest.fixture(scope="module")
def tree(spark):
    a = Tree(batch="a")
    a.split("", projection([3, 7], [1.0, -1.0], -0.5, 0.5))
    a.split("R", projection([5], [2.0], 4.0, 4.0))
    weights = {"": {"w": {7: -1.0, 3: 1.0}, "m0": 1.0, "m1": 3.0, "batches": ["a"]},
               "R": {"w": {5: 2.0}, "m0": 0.0, "m1": 12.0, "batches": ["a"]}}
    return ConsensusTree({"a": a}, Tree(), spark.createDataFrame([("x", 3)], "feature string, i long"), weights)


ROWS = [("a", "low", [7], [1.0], ""), ("a", "between", [3, 7], [2.0, 2.0], ""), ("a", "none", [], [], ""), ("a", "right", [3], [1.0], "RL"),
        ("a", "far", [3, 5, 9], [1.0, 2.5, 8.0], "RR"), ("new", "right", [3], [2.5], "RL"), ("new", "low", [3], [1.5], "L"),
        ("new", "middle", [3], [2.0], ""), (None, "far", [3, 5], [2.5, 3.5], "RR")]


def test_streamed_leaves_equal_batch_in_any_order(spark, tree, tmp_path):
    cells = spark.createDataFrame([r[:4] for r in ROWS], PACKED)
    want = {(b, c): p for b, c, _, _, p in ROWS} | {("a", "low"): "L"}
    batch = {(r.batch, r.cell_id): (r.path, r.stuck) for r in scorer.score_stored(cells, tree).collect()}
    assert {k: p for k, (p, _) in batch.items()} == want
    assert {k for k, (_, stuck) in batch.items() if stuck} == {("a", "between"), ("a", "none"), ("new", "middle")}
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i in (4, 0, 8, 2, 6, 1, 7, 3, 5):
        cells.filter((F.col("cell_id") == ROWS[i][1]) & F.col("batch").eqNullSafe(ROWS[i][0])).coalesce(1).write.mode("append").parquet(source)
    stream = scorer.read_cells(spark, source, cells.schema, 2)
    scorer.run_to_table(scorer.score_stored(stream, tree), sink, str(tmp_path / "state"))
    assert {(r.batch, r.cell_id): (r.path, r.stuck) for r in spark.read.parquet(sink).collect()} == batch


def test_windows_close_once_and_late_rows_are_counted_until_then(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 5, d, h)
    files = [[("a", day(1, 3), "L"), ("b", day(2, 4), "R")],      # latest time: 2 May 4:00
             [("a", day(1, 9), "L"), ("b", day(3, 1), "R")],      # 1 May is late, but its window is open
             [("a", day(4, 2), "R")], [("a", day(4, 3), "R")],    # with two days' lateness 1 May closes, one micro-batch after the row that moved the mark
             [("a", day(1, 5), "L"), ("b", day(2, 6), "R")]]      # too late for 1 May, in time for 2 May
    schema = "batch string, ts timestamp, leaf string"
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def drain():
        counts = scorer.leaf_counts(scorer.read_cells(spark, source, spark.createDataFrame([], schema).schema, 1), "ts", "leaf",
                                    late="2 days", by=["batch"])
        scorer.run_to_table(counts, sink, state)
        return sorted((r.window_start.day, r.batch, r.leaf, r.n) for r in spark.read.parquet(sink).collect())

    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    assert drain() == [(1, "a", "L", 2)]
    spark.createDataFrame([("b", day(9), "R")], schema).coalesce(1).write.mode("append").parquet(source)
    assert drain() == [(1, "a", "L", 2), (2, "b", "R", 2), (3, "b", "R", 1), (4, "a", "R", 2)]


def test_label_projections_are_per_document(spark):
    from markertree.plans.queries_models import label_directions, project_labels

    long = spark.createDataFrame(
        [("a", "x", 2.0, "de"), ("a", "y", 1.0, "de"), ("b", "x", 1.0, "de"), ("c", "z", 5.0, "es")], "cell_id string, feature string, value double, batch string")
    training = spark.createDataFrame(
        [("a", "de", 1, 0), ("b", "de", 0, 1), ("b", "de", 0, 1), ("d", "fr", 0, 1)], "cell_id string, batch string, toxic int, quality int")
    chosen = label_directions(long, training, ("toxic", "quality"))
    assert {r["feature"]: r["w"] for r in chosen["toxic"].collect()} == {"x": 1.0 * 3 - 2 * 1, "y": 3.0}
    assert {r["feature"]: r["w"] for r in chosen["quality"].collect()} == {"x": 2.0 * 1 - 1 * 3, "y": -3.0}
    found = sorted((r["cell_id"], r["h_toxic"], r["h_quality"]) for r in project_labels(training, long, chosen).collect())
    assert found == [("a", 5.0, -5.0), ("b", 1.0, -1.0), ("b", 1.0, -1.0), ("d", 0.0, 0.0)]
