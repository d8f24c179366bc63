"""Wide sparse views: the narrow solution on narrow tables, planted components on views of 200,000 features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markertree.operators import linear as L
from markertree.operators import wide_views as W


@pytest.fixture(scope="module")
def narrow(spark):
    rng = np.random.default_rng(4)
    n, widths = 300, [6, 5, 7]
    z = rng.standard_normal((n, 2)) * [2.0, 1.2]
    x = [z @ rng.standard_normal((2, w)) + rng.standard_normal((n, w)) for w in widths]
    absent = [(i + v) % (4 + v) == 0 for v in range(3) for i in range(n)]
    rows = [(i, *[None if absent[v * n + i] else x[v][i].tolist() for v in range(3)]) for i in range(n)]
    dense = spark.createDataFrame(rows, "row long, a array<double>, b array<double>, c array<double>")
    entries = [(name, i, f"f{j}", float(r[1 + v][j])) for r in rows for v, name in enumerate("abc") if r[1 + v] is not None
               for i in [r[0]] for j in range(widths[v])]
    odd = [("a", None, "f1", 1.0), ("a", 1, None, 1.0), ("b", 2, "f1", None), (None, 1, "f1", 1.0), ("other", 1, "f1", 1.0), ("a", 7, "f0", 0.0)]
    long = spark.createDataFrame(entries + odd, "view string, row long, feature string, value double")
    return dense, widths, long


def test_equals_the_gram_solution_on_a_narrow_table(narrow):
    dense, widths, long = narrow
    plain = L.align_views(dense, ["a", "b", "c"], widths, 2, epochs=4000)
    found = W.align_wide_views(long, ["a", "b", "c"], 2, rounds=40, tolerance=1e-14)
    assert all(b - a >= -1e-9 * abs(a) for a, b in zip(found.objective, found.objective[1:]))
    w = {v: np.zeros((d, 2)) for v, d in zip("abc", widths)}
    for r in found.weights.collect():
        w[r["view"]][int(r["feature"][1:])] = r["w"]
    # components of the two solutions differ by one rotation shared by all views
    turn = W.polar(sum(w[v].T @ q for v, q in zip("abc", plain.maps)))
    assert max(np.abs(w[v] @ turn - q).max() for v, q in zip("abc", plain.maps)) < 1e-6


def test_correlations_and_scale_follow_from_the_scores(narrow):
    _, _, long = narrow
    found = W.align_wide_views(long, ["a", "b", "c"], 2, rounds=15)
    scores = {}
    for r in found.scores.collect():
        scores.setdefault(r["view"], {})[r["row"]] = np.array(r["scores"])
    for v in "abc":
        s = np.array(list(scores[v].values()))
        assert np.allclose(s.T @ s, np.eye(2), atol=1e-6)
    for i, j, c, value in found.correlations:
        a, b = scores["abc"[i]], scores["abc"[j]]
        both = sorted(set(a) & set(b))
        x, y = np.array([a[r][c] for r in both]), np.array([b[r][c] for r in both])
        assert value == pytest.approx(float(x @ y / np.sqrt((x @ x) * (y @ y))), abs=1e-8)
    again = {(r["row"], r["view"]): r["scores"] for r in W.project_views(long.dropna(), found.weights).collect()}
    assert all(np.allclose(again[row, v], s) for v in "abc" for row, s in scores[v].items())


def test_planted_topics_in_views_of_200_000_features(spark):
    """Three views of 200,000 features each; rows of the same topic share features in no view but through the topic."""
    rows = spark.range(3000).select("id", F.explode(F.array(*[F.lit(v) for v in "abc"])).alias("view")).filter(
        ~((F.col("view") == "b") & (F.col("id") % 5 == 0)))
    topic = F.col("id") % 3
    pick = lambda n: F.when(F.lit(n) % 2 == 0, F.pmod(F.xxhash64("id", "view", F.lit(n)), F.lit(200_000))).otherwise(
        F.pmod(F.xxhash64("id", "view", F.lit(n)), F.lit(50)) + 60_000 * topic)
    long = rows.select("view", F.col("id").alias("row"), F.explode(F.array(*[pick(n) for n in range(40)])).alias("feature"), F.lit(1.0).alias("value"))
    assert long.select("feature").distinct().count() > 50_000
    found = W.align_wide_views(long, ["a", "b", "c"], 3, rounds=4, reg=1.0)
    by_view = {}
    for r in found.scores.collect():
        by_view.setdefault(r["view"], []).append((r["row"] % 3, r["scores"]))
    for pairs in by_view.values():
        label, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        fitted = np.vstack([s[label == t].mean(axis=0) for t in range(3)])
        nearest = ((s[:, None, :] - fitted[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (nearest == label).mean() > 0.98


def test_views_must_share_rows(spark):
    long = spark.createDataFrame([("a", 1, "f", 1.0), ("b", 2, "f", 1.0)], "view string, row long, feature string, value double")
    with pytest.raises(ValueError):
        W.align_wide_views(long, ["a", "b"], 1)


def test_rounds_move_ids_and_refuse_a_clash(narrow, monkeypatch):
    _, _, long = narrow
    stored, keep = [], W.materialize
    monkeypatch.setattr(W, "materialize", lambda df: stored.append(df.columns) or keep(df))
    found = W.align_wide_views(long, ["a", "b", "c"], 2, rounds=2)
    assert sorted(found.weights.columns) == ["feature", "view", "w"] and found.weights.count() == 18
    assert [c for c in stored if "feature" in c] == [["view", "row", "feature", "value"], ["id", "view", "feature", "d"]]
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(1).cast("long"))
    with pytest.raises(ValueError, match="same 64-bit hash"):
        W.align_wide_views(long, ["a", "b", "c"], 2, rounds=1)


def test_groups_and_parts_change_nothing_and_entries_stay_in_place(narrow, spark, monkeypatch):
    _, _, long = narrow
    whole = W.align_wide_views(long, ["a", "b", "c"], 2, rounds=5)
    known = {(r["view"], r["feature"]): r["w"] for r in whole.weights.collect()}
    stored, buckets, keep, deal = [], [], W.materialize, W._bucketed
    monkeypatch.setattr(W, "materialize", lambda df: stored.append(df.columns) or keep(df))
    monkeypatch.setattr(W, "_bucketed", lambda *a: buckets.append(deal(*a)) or buckets[-1])
    monkeypatch.setattr(W, "LEAST_GROUP", 4)
    found = W.align_wide_views(long, ["a", "b", "c"], 2, rounds=5)
    assert found.objective == pytest.approx(whole.objective, rel=1e-8)
    for r in found.weights.collect():
        assert np.allclose(r["w"], known[r["view"], r["feature"]], atol=1e-4)
    # an entry has no row of its own in what a round reads
    assert not any({"row", "value"} <= set(c) and "feature" not in c for c in stored) and len(buckets) == 6
    assert not any(spark.catalog.tableExists(b._name) for b in buckets)


def test_rounds_read_buckets_without_a_shuffle(spark):
    entries = W._bucketed(spark.range(100).select(F.pmod("id", F.lit(5)).cast("int").alias("group"), "id"), "group", 8)
    pair = entries.groupBy("group").cogroup(spark.range(5).select(F.col("id").cast("int").alias("group")).groupBy("group"))
    plan = pair.applyInArrow(lambda a, b: a, "group int, id long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    W._drop(entries)
