"""Trees as tables: order, ids, labels, pruning, splicing, codes, multiplets."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markertree.functions.stats import gaussian_crossing, mixture_params
from markertree.functions.tree_ids import is_ancestor, node_depth, node_to_path
from markertree.session import bounded_rows


def breadth_first(nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Running number by depth, then id. Node tables are small; the single window is intended."""
    return nodes.withColumn("bfs", F.row_number().over(Window.orderBy(node_depth(node), node)) - 1)


def depth_first(nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Pre-order number: parents first, left before right, which is the order of the path strings."""
    return nodes.withColumn("dfs", F.row_number().over(Window.orderBy(node_to_path(node))) - 1)


def outline(nodes: DataFrame, label: str, node: str = "node_id") -> DataFrame:
    """Indented outline of a tree, one line per node, in pre-order."""
    ordered = depth_first(nodes, node)
    return ordered.select("dfs", node, F.concat(F.repeat(F.lit("  "), node_depth(node)), F.col(label)).alias("line"))


def membership_matrix(assignments: DataFrame, nodes: list, cell: str = "cell_id", node: str = "node_id") -> DataFrame:
    """0/1 matrix: cell x node."""
    return assignments.groupBy(cell).pivot(node, nodes).agg(F.lit(1)).fillna(0)


def side_matrix(sides: DataFrame, nodes: list, cell: str = "cell_id", node: str = "node_id") -> DataFrame:
    """-1 left, 1 right, 0 not in the node."""
    return sides.groupBy(cell).pivot(node, nodes).agg(F.first("side")).fillna(0)


def leaf_labels(assignments: DataFrame, nodes: DataFrame, cell: str = "cell_id", node: str = "node_id") -> DataFrame:
    """``<id>_leaf`` per cell: the deepest node a cell reached, numbered breadth-first."""
    deepest = assignments.groupBy(cell).agg(F.max_by(node, F.struct(node_depth(node), F.col(node))).alias(node))
    numbered = breadth_first(nodes.select(node).distinct(), node)
    return deepest.join(F.broadcast(numbered), node).select(cell, F.concat(F.col("bfs"), F.lit("_leaf")).alias("label"))


def labels_at(assignments: DataFrame, chosen: DataFrame, cell: str = "cell_id", node: str = "node_id") -> DataFrame:
    """Label of each cell at chosen nodes (deepest chosen node wins), null where it meets none.

    ``chosen`` holds node and name and is node-sized.
    """
    hit = assignments.join(F.broadcast(chosen), node)
    return hit.groupBy(cell).agg(F.max_by("name", F.struct(node_depth(node), F.col(node))).alias("label"))


def subtree(nodes: DataFrame, top: int, node: str = "node_id") -> DataFrame:
    return nodes.filter(is_ancestor(F.lit(top), F.col(node)))


def leaves_of(nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes that are nobody's parent."""
    from markertree.functions.tree_ids import node_parent

    parents = nodes.filter(F.col(node) > 0).select(node_parent(node).alias(node)).distinct()
    return nodes.join(parents, node, "left_anti")


def prune(nodes: DataFrame, cut: DataFrame, node: str = "node_id") -> DataFrame:
    """Turn the listed nodes into leaves and hide everything below them.

    Every node has at most 62 ancestors, so the test is a join on its exploded ancestor list,
    an equality, rather than a comparison of all nodes with all cuts.
    """
    cuts = cut.select(F.col(node).alias("_cut")).distinct()
    up = F.sequence(F.lit(0), node_depth(node))
    ancestors = nodes.select(node, F.explode(F.transform(
        up, lambda d: F.call_function("shiftright", F.col(node).cast("bigint") + F.lit(1), d.cast("int")) - F.lit(1))).alias("_cut"))
    below = ancestors.join(cuts, "_cut").groupBy(node).agg(F.min("_cut").alias("cut_at"))
    marked = nodes.join(below, node, "left")
    return marked.filter(F.col("cut_at").isNull() | (F.col("cut_at") == F.col(node))).withColumn(
        "status", F.when(F.col("cut_at") == F.col(node), "cutleaf").otherwise(F.col("status"))
    ).drop("cut_at")


def remap_after_removal(node_ids: list[int], removed: list[int]) -> dict[int, int | None]:
    """New complete-tree ids after deleting subtrees and moving each sibling into its parent's place.

    Works on the node list (driver, node-sized). Deleted nodes, and parents that were spliced out, map to None.
    """
    present, gone = set(node_ids), set(removed)
    new: dict[int, int | None] = {i: None for i in node_ids}

    def place(old: int, slot: int) -> None:
        stack = [(old, slot)]
        while stack:
            i, at = stack.pop()
            if i not in present or i in gone:
                continue
            left, right = 2 * i + 1, 2 * i + 2
            dead = [c for c in (left, right) if c in gone]
            kept = [c for c in (left, right) if c in present and c not in gone]
            if dead and len(kept) == 1:
                stack.append((kept[0], at))
                continue
            new[i] = at
            stack.append((left, 2 * at + 1))
            stack.append((right, 2 * at + 2))

    place(0, 0)
    return new


def splice_out(spark: SparkSession, nodes: DataFrame, removed: list[int], node: str = "node_id") -> DataFrame:
    """Apply a removal to any table keyed by node id; rows of vanished nodes go away."""
    ids = [row[0] for row in bounded_rows(nodes.select(node).distinct())]
    mapping = [(old, to) for old, to in remap_after_removal(ids, removed).items() if to is not None]
    table = spark.createDataFrame(mapping, f"{node} bigint, new_id bigint")
    return nodes.join(F.broadcast(table), node)


def tree_scores(leaves: DataFrame, d: int, covariance: str = "full") -> DataFrame:
    """Total log-likelihood, leaf count and BIC of a tree from its leaf table (n, ll).

    ``ll`` is the weighted leaf log-likelihood, so its sum is the mean log-likelihood of the tree.
    """
    agg = leaves.agg(F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return agg.withColumn(
        "bic", F.lit(-2.0) * F.col("ll") * F.col("n") + mixture_params(F.col("k"), float(d), covariance) * F.log("n"))


def best_cut_by_bic(steps: DataFrame, d: int) -> DataFrame:
    """From a split log (step, leaf, n, ll) choose the step whose leaf set has the lowest BIC."""
    per = steps.groupBy("step").agg(F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    scored = per.withColumn(
        "bic", F.lit(-2.0) * F.col("ll") * F.col("n") + mixture_params(F.col("k"), float(d)) * F.log("n"))
    best = scored.agg(F.min_by("step", F.struct("bic", "step")).alias("step"))
    return scored.join(F.broadcast(best), "step", "left_semi")


def marker_cutoffs(components: DataFrame) -> DataFrame:
    """Cut per marker from its two components (feature, comp in 0/1, weight, mean, var)."""
    s = lambda k, c: F.max(F.when(F.col("comp") == k, F.col(c)))
    wide = components.groupBy("feature").agg(
        *[s(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("weight", "mean", "var")])
    cut = gaussian_crossing("mean0", F.sqrt("var0"), "weight0", "mean1", F.sqrt("var1"), "weight1")
    return wide.select("feature", cut.alias("cutoff"))


def leaf_codes(leaf_means: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Binary code per leaf: 1 where the leaf mean exceeds the marker cut. Input (leaf, n, feature, mean)."""
    bits = leaf_means.join(cutoffs, "feature").withColumn("bit", F.when(F.col("mean") > F.col("cutoff"), "1").otherwise("0"))
    ordered = F.array_sort(F.collect_list(F.struct("feature", "bit")))
    return bits.groupBy("leaf").agg(F.max("n").alias("n"), F.concat_ws("", F.transform(ordered, lambda e: e["bit"])).alias("code"))


def flag_multiplets(cells: DataFrame, types: DataFrame, leaf: str = "leaf") -> DataFrame:
    """1 for cells in artificial leaves; the type table has one row per leaf."""
    marks = types.select(F.col("leaf").alias(leaf), (1 - F.col("basis")).alias("multiplet"))
    return cells.join(marks, leaf)


def multiplet_ratio(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.avg("multiplet").alias("multiplet_ratio"))


def tree_levels(nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes and leaves per depth."""
    leaf = leaves_of(nodes.select(node), node).withColumn("_leaf", F.lit(1))
    return nodes.select(node).join(leaf, node, "left").groupBy(node_depth(node).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("_leaf"), F.lit(0)).alias("n_leaves"))
