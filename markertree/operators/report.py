"""Report tables: what a plot of a node, a leaf or a tree would show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.functions.stats import normal_logpdf
from markertree.operators.moments import histogram
from markertree.operators.select import top_per_group
from markertree.session import sized


def density_grid(df: DataFrame, lo: str, hi: str, n: int) -> DataFrame:
    """n evenly spaced points between two columns, as rows."""
    step = (F.col(hi) - F.col(lo)) / F.lit(float(n - 1))
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point")).withColumn("x", F.col(lo) + F.col("point") * step)


def component_curves(components: DataFrame, limits: DataFrame, group: list[str], points: int = 500) -> DataFrame:
    """Weighted density of every 1-D component on a grid over its marker's range.

    Components (group, feature, comp, weight, mean, var, merged_to) and limits (group, feature, lo, hi) are node-sized.
    """
    grid = density_grid(components.join(limits, [*group, "feature"]), "lo", "hi", points)
    return grid.select(*group, "feature", "comp", "merged_to", "point", "x",
                       (F.col("weight") * F.exp(normal_logpdf("x", "mean", "var"))).alias("density"))


def merged_curves(curves: DataFrame, group: list[str]) -> DataFrame:
    return curves.groupBy(*group, "feature", "merged_to", "point").agg(F.max("x").alias("x"), F.sum("density").alias("density"))


def subset_against_background(long: DataFrame, members: DataFrame, bins: int = 50, on: str = "cell_id") -> DataFrame:
    """Histograms of every feature for a subset and for all cells, over shared bins."""
    tagged = long.join(members.select(on).withColumn("_in", F.lit(1)), on, "left")
    limits = sized(long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    ranged = tagged.join(limits, "feature").filter("_hi > _lo")
    roles = ranged.withColumn("role", F.explode(F.when(F.col("_in") == 1, F.array(F.lit("subset"), F.lit("all"))).otherwise(F.array(F.lit("all")))))
    return histogram(roles, ["role", "feature"], "value", F.col("_lo"), F.col("_hi"), bins)


def marker_in_largest_leaves(assigned: DataFrame, leaf: str, marker: str, bins: int = 30, leaves: int = 12) -> DataFrame:
    """Distribution of a marker in the largest leaves (a top-k report)."""
    sizes = assigned.groupBy(leaf).agg(F.count(F.lit(1)).alias("_size"))
    big = sized(sizes.orderBy(F.desc("_size"), F.asc(leaf)).limit(leaves))
    ends = assigned.agg(F.min(marker).alias("_lo"), F.max(marker).alias("_hi"))
    from markertree.session import attach_row

    return histogram(attach_row(assigned.join(big, leaf), ends), [leaf], marker, F.col("_lo"), F.col("_hi"), bins)


def side_histograms(h: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """Histograms of projections per node, side and role (train or query) over each node's range."""
    ends = sized(h.groupBy("node_id").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi")).filter("_hi > _lo"))
    return histogram(h.join(ends, "node_id"), ["node_id", *by], "h", F.col("_lo"), F.col("_hi"), bins)


def pair_scatter(cells: DataFrame, pair: tuple[str, str], raw, merged, per_cluster: int | None = None, key: str = "cell_id") -> DataFrame:
    """Coordinates of a marker pair with raw and merged cluster; ``per_cluster`` asks for a display sample by key hash."""
    a, b = pair
    labelled = cells.select(key, F.col(a).alias("x"), F.col(b).alias("y"), raw.alias("raw"), merged.alias("merged"))
    if per_cluster is None:
        return labelled
    return top_per_group(labelled, ["raw"], [F.xxhash64(key).asc(), F.asc(key)], per_cluster).drop("rank")


def tree_edges(nodes: DataFrame, root_mean: dict[str, float], root_sd: dict[str, float], top_share: int = 2) -> DataFrame:
    """Nodes with label, size, percent of the root, and the offsets of each side's key-marker means in root deviations."""
    root = nodes.filter(F.col("path") == "").select(F.col("n").alias("_root"))
    from markertree.session import attach_row

    lookup = lambda d: F.create_map(*[v for k, x in sorted(d.items()) for v in (F.lit(k), F.lit(float(x)))])
    base = attach_row(nodes, root)
    offset = lambda means: F.zip_with("key", F.coalesce(F.col(means), F.array().cast("array<double>")),
                                      lambda k, m: (m - lookup(root_mean)[k]) / lookup(root_sd)[k])
    return base.select(
        "batch", "path", F.array_join("key", "_").alias("label"), "n",
        F.round(F.col("n") / F.col("_root") * 100, top_share).alias("percent"), "status", "stop", "dominant",
        offset("mean_left").alias("offset_left"), offset("mean_right").alias("offset_right"))


def shared_tree_report(nodes: DataFrame, shown: int = 4) -> DataFrame:
    """Model nodes: cells of all batches and the training batches (a count when there are many)."""
    batches = F.from_json("rule", "batches array<string>")["batches"]
    return nodes.filter(F.col("batch").isNull()).select(
        "path", F.array_join("key", "_").alias("label"), "n", "score",
        F.when(F.size(batches) <= shown, F.array_join(batches, ",")).when(F.size(batches) > shown, F.concat(F.size(batches).cast("string"), F.lit(" batches"))).alias("trained_on"),
        "mean_left", "mean_right")


def key_marker_report(components: DataFrame, node: str, path: str) -> DataFrame:
    """Components of one node's markers ordered by mean."""
    return components.filter(F.col(node) == path).orderBy(F.element_at("mean", 1), "comp")


