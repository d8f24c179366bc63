"""Subset joins, OR groups and leaf types against brute force."""

import random
import time
from itertools import combinations, combinations_with_replacement

import numpy as np
import pytest

from markertree.operators import codes as C


@pytest.fixture(scope="module")
def some(spark):
    r = random.Random(6)
    rows = [(f"l{i:02d}", r.randint(1, 500), "".join(r.choices("01", k=12, weights=[3, 2]))) for i in range(40)]
    rows += [("m0", 7, rows[0][2]), ("m1", 9, "0" * 12), ("m2", 3, "".join(str(int(a) | int(b)) for a, b in zip(rows[1][2], rows[2][2])))]
    return rows, spark.createDataFrame(rows, "leaf string, n bigint, code string")


def test_subsets(spark, some):
    rows, _ = some
    v = sorted({int(c, 2) for _, _, c in rows})
    table = spark.createDataFrame([(x,) for x in v], "v bigint")
    assert sorted(map(tuple, C.subset_pairs(table, table).collect())) == [(c, a) for c in v for a in v if a | c == c]


@pytest.mark.parametrize("size", [2, 3])
def test_or_groups(some, size):
    rows, table = some
    v = {leaf: int(c, 2) for leaf, _, c in rows}
    want = set()
    for group in combinations(sorted(v), size):
        value = 0
        for g in group:
            value |= v[g]
        want |= {(*group, c) for c in v if v[c] == value and c not in group}
    found = list(map(tuple, C.or_groups(table, size).collect()))
    assert len(found) == len(set(found)) and set(found) == want


def brute_types(rows):
    total, basis, out = sum(n for _, n, _ in rows), [], {}
    for leaf, n, code in sorted(rows, key=lambda r: (-r[1], r[0])):
        t = int(code, 2)
        groups = [g for g in combinations_with_replacement(basis, 2) if g[0][0] | g[1][0] == t] or [
            g for g in combinations(basis, 3) if g[0][0] | g[1][0] | g[2][0] == t]
        if not groups:
            basis.append((t, n / total))
        out[leaf] = (0 if groups else 1, len(groups), max((np.prod([s for _, s in g]) for g in groups), default=0.0) / (n / total))
    return out


def test_leaf_types(some):
    rows, table = some
    want = brute_types(rows)
    found = {r["leaf"]: (r["basis"], r["groups"], r["merge_constant"]) for r in C.leaf_types(table).collect()}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in want.items()}
    assert all(found[k][2] == pytest.approx(want[k][2]) for k in want)


def test_20_000_codes_in_under_a_minute(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 40, 20_000) & rng.integers(0, 1 << 40, 20_000)
    table = spark.createDataFrame([(f"{i:06d}", 200_000 - i, format(int(x), "040b")) for i, x in enumerate(v)], "leaf string, n bigint, code string").repartition(8)
    table.count()
    start = time.time()
    types = C.leaf_types(table).groupBy("basis").count().collect()
    assert sum(r["count"] for r in types) == 20_000 and time.time() - start < 60


def test_no_leaves(spark):
    assert C.leaf_types(spark.createDataFrame([], "leaf string, n bigint, code string")).count() == 0
