"""Comparison of the tree with plain mixtures: time, mean log-likelihood and components per method."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from markertree.operators.em import best_by_bic, fit_models
from markertree.plans.grow import grow

RECORD = "idx int, time double, ll double, n_component double, db string, method string"


def run_harness(cells: DataFrame, markers: list[str], name: str, repeats: int = 10, max_k: int = 50, profile="marker") -> DataFrame:
    """One record per repeat and method: the tree, full and diagonal mixtures by BIC, and both with the tree's size."""
    rows = []
    for i in range(repeats):
        start = time.time()
        tree = grow(cells, markers, profile, store=True)
        k = max(len(tree.leaves()), 1)
        rows.append((i, time.time() - start, float(tree.total_ll()), float(k), name, "tree"))
        for method, diagonal in (("mixture", False), ("diagonal", True)):
            start = time.time()
            best = best_by_bic(cells, markers, max_k, diagonal)
            rows.append((i, time.time() - start, float(best.mean_ll), float(best.k), name, method))
            start = time.time()
            fixed = fit_models(cells, markers, [k], diagonal)[0]
            rows.append((i, time.time() - start, float(fixed.mean_ll), float(k), name, f"{method}_fixk"))
    return cells.sparkSession.createDataFrame(rows, RECORD)
