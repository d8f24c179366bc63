"""Passes over a stored multi-batch tree: new directions, other splits of the projection, fills, identity space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.operators import linear as L
from markertree.operators import votes as V
from markertree.operators.assign import project, side_posterior
from markertree.operators.normalize import depth_scaled_weights, standardize_weights
from markertree.plans.grow import split_two_components
from markertree.session import bounded_rows


def confident_sides(sides: DataFrame, markers: list[str], bar: float = 0.99, by: list[str] = ("batch",)) -> DataFrame:
    """Cells sure of their side by the two-Gaussian posterior per batch (chained when a parent posterior is present)."""
    chain = "posterior_parent" if "posterior_parent" in sides.columns else None
    return side_posterior(sides, "side", markers, list(by), chain=chain, keep_above=bar)


def pseudo_marker(rows: DataFrame, width: int, ridge: float = 0.1, align: float = 1.0, shrink: float = 10.0,
                  idx: str = "idx", val: str = "val") -> dict:
    """Shared direction and shrunken per-batch corrections from labelled rows (batch, side, idx, val).

    One Gram per (batch, side). Returns w, the corrections and each batch's class means on its own direction.
    """
    grams = L.gram(rows, width, ["batch", "side"], array=None, idx=idx, val=val)
    within, gaps, ends = {}, {}, {}
    for b in sorted({k[0] for k in grams}):
        left, right = grams.get((b, "L")), grams.get((b, "R"))
        if left is None or right is None or left.n + right.n < 4:
            continue
        within[b] = (left.scatter + right.scatter) / (left.n + right.n - 2)
        gaps[b] = right.mean - left.mean
        ends[b] = (left.mean, right.mean)
    w, delta = V.batch_directions(within, gaps, ridge, align, shrink)
    means = {b: tuple(float((w + delta[b]) @ m) for m in ends[b]) for b in gaps}
    return {"w": w, "delta": delta, "means": means}


def retrain_node(rows: DataFrame, width: int, markers: list[str], bar: float = 0.9, **options) -> dict:
    """Refresh one node: sure cells only, new directions from them, then every row's side by its projection.

    ``rows`` has batch, side, the key markers and packed expression; the middle of a batch's class means is its cut.
    """
    sure = confident_sides(rows, markers, bar)
    model = pseudo_marker(sure, width, **options)
    maps = {b: model["w"] + model["delta"][b] for b in model["delta"]}
    h = None
    for b, w in sorted(maps.items()):
        # one literal vector per batch: the list of batches is short and fixed
        dot = L.sparse_dot("idx", "val", list(w))
        h = F.when(F.col("batch") == b, dot) if h is None else h.when(F.col("batch") == b, dot)
    middle = None
    for b, (m0, m1) in sorted(model["means"].items()):
        c = F.lit((m0 + m1) / 2)
        middle = F.when(F.col("batch") == b, c) if middle is None else middle.when(F.col("batch") == b, c)
    out = rows.withColumn("h", h).withColumn("_mid", middle)
    return {"model": model, "cells": out.withColumn("side", F.when(F.col("h") > F.col("_mid"), "R").otherwise("L")).drop("_mid")}


def split_projection_by_mixture(h: DataFrame, group: list[str]) -> DataFrame:
    """Sides from a two-component mixture of the projection instead of cuts; groups where it does not fit stay null."""
    from markertree.plans.tree import side_column

    rules = split_two_components(h.select(*group, "h"), "h", group)
    side = None
    for key, rule in sorted(rules.items(), key=str):
        if rule is None:
            continue
        cond = F.lit(True)
        for c, v in zip(group, key):
            cond = cond & (F.col(c) == F.lit(v))
        s = side_column(rule)
        side = F.when(cond, s) if side is None else side.when(cond, s)
    return h.withColumn("side", side if side is not None else F.lit(None).cast("string"))


def pass_through(nodes: DataFrame, failed: DataFrame) -> DataFrame:
    """Nodes that could not separate keep their cells on both sides (zero means, full shares)."""
    hit = nodes.join(failed.select("path", F.lit(True).alias("_failed")), "path", "left")
    both = F.coalesce("_failed", F.lit(False))
    zeros = F.array(F.lit(0.0))
    return hit.withColumn("n_left", F.when(both, F.col("n")).otherwise(F.col("n_left"))).withColumn(
        "n_right", F.when(both, F.col("n")).otherwise(F.col("n_right"))).withColumn(
        "mean_left", F.when(both, zeros).otherwise(F.col("mean_left"))).withColumn(
        "mean_right", F.when(both, zeros).otherwise(F.col("mean_right"))).drop("_failed")


def stored_components(projections: DataFrame, node_id: int, batch: str | None = None) -> DataFrame:
    """Components or projections kept for a node, for one batch or all."""
    out = projections.filter(F.col("node_id") == node_id)
    return out if batch is None else out.filter(F.col("batch") == batch)


def identity_space(long: DataFrame, weights: DataFrame, cell: list[str] = ("cell_id",)) -> DataFrame:
    """Z = X M for all nodes at once: standardised, depth-scaled weights per node, one join."""
    scaled = depth_scaled_weights(standardize_weights(weights))
    return project(long, scaled, cell, ["node_id"])


def batch_projections(long: DataFrame, weights: DataFrame, cell: list[str] = ("batch", "cell_id")) -> DataFrame:
    """Per-batch weights (batch, node_id, feature, w): the pseudo-marker value of each cell at each node."""
    return project(long, weights, cell, ["batch", "node_id"])


def pooled_components(rows: DataFrame, width: int, components: int = 5, min_cells: int = 100, scale: bool = True) -> DataFrame:
    """Components of all batches together (for batches without a panel), named CC_1…; batches below ``min_cells`` are left out.

    ``rows`` holds batch, cell_id and packed rows over the shared, batch-aware variable features.
    """
    model = L.pca(rows, components, width, scale, array=None, idx="idx", val="val")
    big = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_cells).select("batch")
    scored = L.apply_map(rows.join(big, "batch", "left_semi"), model.matrix, model.offset, None, "idx", "val")
    return scored.select("batch", "cell_id", *[F.element_at("scores", i + 1).alias(f"CC_{i + 1}") for i in range(components)])


PASSES = ("retrain", "mixture", "fill")


def refresh_level(rows: DataFrame, width: int, markers: list[str], passes: list[str], k: int = 10) -> DataFrame:
    """Run a list of passes over the cells of one node (batch, cell_id, side, markers, idx, val).

    retrain: new direction and sides; mixture: sides from a mixture of the projection; fill: unassigned cells take the vote of
    their nearest assigned cells on the projection.
    """
    from markertree.operators.neighbors import fill_unassigned

    out = rows
    for step in passes:
        if step not in PASSES:
            raise ValueError(f"unknown pass {step!r}")
        if step == "retrain":
            out = retrain_node(out, width, markers)["cells"]
        elif step == "mixture":
            out = split_projection_by_mixture(out, ["batch"])
        else:
            space = out.withColumn("_vec", F.array(F.col("h")))
            out = fill_unassigned(space, k, "cell_id", "_vec", "side").drop("_vec")
    return out


def side_sizes(cells: DataFrame, by: list[str]) -> list:
    return bounded_rows(cells.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n")))


