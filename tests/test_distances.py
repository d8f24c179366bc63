"""Mean Euclidean distances of groups, exact over many parts and estimated from some."""

import numpy as np
import pytest

from markertree.operators import evaluate as E


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 5))
    side = np.where(rng.random(300) < 0.3, "L", "R")
    x[side == "R"] += 2.0
    node = rng.integers(0, 2, 300)
    rows = [(i, int(node[i]), side[i], x[i].tolist()) for i in range(300)] + [(900, 0, "U", [0.0] * 5), (901, 0, "L", None), (902, None, "L", [0.0] * 5)]
    return x, side, node, spark.createDataFrame(rows, "id long, node int, side string, x array<double>")


@pytest.mark.parametrize("chunk", [7, 64, 1024])
def test_equals_the_distance_matrix(points, chunk):
    x, side, node, table = points
    found = {r["node"]: r for r in E.side_separation(table, "node", "side", "x", "id", chunk=chunk).collect()}
    assert sorted(found) == [0, 1]
    for k, r in found.items():
        left, right = x[(node == k) & (side == "L")], x[(node == k) & (side == "R")]
        mean = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
        assert (r["n_left"], r["n_right"]) == (len(left), len(right))
        assert np.allclose([r["within_left"], r["within_right"], r["across"]], [mean(left, left), mean(right, right), mean(left, right)])


def test_estimate_lies_within_its_error(points):
    _, _, _, table = points
    exact = {(r["node"], r["a"], r["b"]): r["distance"] for r in E.group_distances(table, "node", "side", "id", "x", chunk=8).collect()}
    some = E.group_distances(table, "node", "side", "id", "x", chunk=8, share=0.3).collect()
    full = {(r["node"], r["a"], r["b"]): r["pairs"] for r in E.group_distances(table, "node", "side", "id", "x", chunk=8).collect()}
    for r in some:
        key = (r["node"], r["a"], r["b"])
        if r["a"] != "U" and r["b"] != "U":
            assert r["pairs"] < 0.6 * full[key] and abs(r["distance"] - exact[key]) < 4 * r["error"]


def test_share_is_checked(points):
    with pytest.raises(ValueError):
        E.group_distances(points[3], "node", "side", "id", "x", share=0)


def test_products_keep_the_digits_of_close_and_odd_rows():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 64)) + 1e4
    b = np.concatenate([a[:300], a[:50] + 1e-6, rng.standard_normal((80, 64))])  # copies, near copies and far rows
    want = sum(np.sqrt(((row - b) ** 2).sum(axis=1)).sum() for row in a)
    total, n = E.distance_sum(a, b, cells=5000)
    assert n == 400 * 430 and abs(total / want - 1) < 1e-9
    copies, n = E.distance_sum(np.tile(a[:1], (90, 1)), np.tile(a[:1], (70, 1)), cells=1000)
    assert (copies, n) == (0.0, 6300)
    odd = np.array([[np.inf, 0.0]])
    assert E.distance_sum(odd, np.zeros((3, 2)))[0] == np.inf and E.distance_sum(np.zeros((3, 2)), odd)[0] == np.inf
    assert np.isnan(E.distance_sum(np.array([[np.nan, 0.0]]), np.zeros((2, 2)))[0]) and E.distance_sum(a[:0], b) == (0.0, 0)


def test_only_wanted_groups_are_measured(points):
    _, _, _, table = points
    args = ("node", "side", "id", "x")
    every = {(r["node"], r["a"], r["b"]): (r["pairs"], r["distance"]) for r in E.group_distances(table, *args, chunk=8).collect()}
    some = {(r["node"], r["a"], r["b"]): (r["pairs"], r["distance"]) for r in E.group_distances(table, *args, chunk=8, wanted=[("L", "R")]).collect()}
    assert some == {k: (n, pytest.approx(d)) for k, (n, d) in every.items() if k[1:] == ("L", "R")} and len(some) == 2
