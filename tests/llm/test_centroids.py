"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

import pytest

from markertree.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, x string"


def plain(rows, k, rounds, dim):
    kept = [(i, [min(max(math.floor(256 * c), -centroids.LIMIT), centroids.LIMIT) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    now = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(now)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    top = (1 << 63) - 1
    found = [(i, c, min(d, top)) for i, c, d in found]
    total = {n: sum(d for _, c, d in found if c == n) for n in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, c, d, min(total[c], top), min(sum(total.values()), top), digest[c]) for i, c, d in found), key=key)


@pytest.mark.parametrize("size", [1.0, 3e9, 1e30])
def test_clusters_equal_a_plain_version(spark, size):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (size if i % 9 == 0 else 1.0) for _ in range(6)]) for i in range(90)]
    rows += [(200, rows[4][1]), (5, rows[5][1]), (5, rows[5][1]), (None, [0.1] * 6), (None, [0.1] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [None] + [1.0] * 5), (304, [math.nan] + [1.0] * 5), (305, [math.inf] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    found = centroids.cluster(table, k=7, rounds=3, dim=6).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(f) for f in found), key=key) == plain(rows, 7, 3, 6)


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(1, [0.0, 1.0], 1, 2, "x"), (2, [0.0, 1.0], 1, 2, "x")], SCHEMA)
    assert [(f.cluster, f.inertia) for f in centroids.cluster(two, dim=2).collect()] == [(0, 0), (0, 0)]
    empty = centroids.cluster(two.limit(0), dim=2)
    assert empty.count() == 0 and empty.columns == centroids.cluster(two, dim=2).columns


def test_table_passes_only_as_sums(spark):
    """A round's plan aggregates before its one exchange and has no Python worker."""
    rows = spark.createDataFrame([(i, [float(i)] * 3, 1, 2, "x") for i in range(20)], SCHEMA)
    x = centroids.quantized(rows, 3, 256).select(centroids.nearest([[0, 0, 0], [9, 9, 9]], "x", "bigint")["cluster"].alias("c"))
    plan = x.groupBy("c").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan and "Arrow" not in plan
