"""Queries over fitted models: mixtures, trees, consensus, linear maps, reports and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from markertree.operators import em as EM
from markertree.operators import evaluate as E
from markertree.operators import features as FE
from markertree.operators import linear as L
from markertree.operators import wide_views as WV
from markertree.operators import metagenes as MG
from markertree.operators import moments as M
from markertree.operators import report as RP
from markertree.operators import scan as S
from markertree.operators import votes as V
from markertree.operators.normalize import log_transform, wide_markers
from markertree.operators.profiles import PROFILES
from markertree.plans import expression as X
from markertree.plans import postpass as PP
from markertree.plans import treestore as TS
from markertree.plans.consensus import grow_consensus, leaf_table, pack_expression
from markertree.plans.grow import grow, reopen
from markertree.plans.queries_tables import NODE_WEIGHTS_SQL, event_weights, scratch
from markertree.plans.refresh import grow_refreshed
from markertree.plans.registry import LINE_SQL, ORACLES, TOKENS_SQL, query, r, rounded
from markertree.plans.tree import Tree
from markertree.session import materialize
from markertree.sources import writers as W
from markertree.sources.schema import NODES
from markertree.sources.tables import (
    DOC_MARKERS, MARKERS, document_expression, document_markers, embedding_dims, line_cells, line_long, packed_documents, table, token_counts,
)
from markertree.streaming import scorer

COLS = ["key", "n", "n_unique", "k_bic", "k_merged", "similarity", "dip", "filter", "separable", "score"]


# ---------------------------------------------------------------- mixtures

@query("dip_by_marker", "MIX-10 VIS-7 UDF-2")
def dip_by_marker(spark, sf):
    return S.dip_statistics(materialize(document_markers(spark, sf)), ["batch"], DOC_MARKERS)


@query("component_count_curves", "MIX-1 MIX-3")
def component_count_curves(spark, sf):
    return S.component_count_curve(materialize(document_markers(spark, sf)), ["batch"], DOC_MARKERS, 6)


@query("marker_scan", "MIX-1 MIX-6 MIX-6a MIX-9 MIX-11 SPL-1 SPL-2 SPL-3")
def marker_scan(spark, sf):
    cells = materialize(document_markers(spark, sf))
    limits = S.group_limits(cells, ["batch"], DOC_MARKERS)
    return S.scan_markers(cells, ["batch"], DOC_MARKERS, limits, PROFILES["marker"]).select("batch", *COLS)


@query("marker_scan_entropy", "MIX-12 SPL-2")
def marker_scan_entropy(spark, sf):
    cells = materialize(document_markers(spark, sf))
    limits = S.group_limits(cells, ["batch"], DOC_MARKERS)
    return S.scan_markers(cells, ["batch"], DOC_MARKERS, limits, PROFILES["entropy"]).select("batch", *COLS, "entropy")


@query("marker_pair_scan", "SPL-1 JOI-9 MIX-1")
def marker_pair_scan(spark, sf):
    cells = materialize(document_markers(spark, sf).select("batch", *DOC_MARKERS))
    limits = S.group_limits(cells, ["batch"], DOC_MARKERS)
    pairs = [(b, "share_a", "share_e") for b in ("b0", "b1", "b2")] + [(b, "share_n", "share_o") for b in ("b0", "b1", "b2")]
    return S.scan_pairs(cells, ["batch"], pairs, limits, PROFILES["consensus"]).select("batch", *COLS)


@query("marker_components", "MIX-1 MIX-6 UDF-2")
def marker_components(spark, sf):
    cells = materialize(document_markers(spark, sf))
    limits = S.group_limits(cells, ["batch"], DOC_MARKERS)
    return S.component_table(S.scan_markers(cells, ["batch"], DOC_MARKERS, limits, PROFILES["marker"]), ["batch"])


@query("full_table_mixtures", "MIX-1 MIX-19 EVL-7")
def full_table_mixtures(spark, sf):
    """BIC search with full and diagonal covariance over all order lines."""
    cells = log_transform(line_long(spark, sf))
    wide = materialize(wide_markers(cells, MARKERS).select(*MARKERS))  # one shuffle, then every pass reads the stored markers
    rows = []
    for kind in (False, True):
        for m in EM.fit_models(wide, MARKERS, [1, 2, 3, 4], kind, max_iter=15):
            rows.append(("diag" if kind else "full", m.k, m.n, float(m.mean_ll), float(m.bic())))
    return spark.createDataFrame(rows, "covariance string, k int, n bigint, ll double, bic double")


# ---------------------------------------------------------------- single-table trees

def document_tree(spark, sf):
    return grow(document_markers(spark, sf).select("cell_id", *DOC_MARKERS), DOC_MARKERS, PROFILES["marker"].with_options(min_cells=100, min_side=30), store=True)


@query("marker_tree_nodes", "SPL-5 SPL-6 SPL-8 SPL-9 AGG-5")
def marker_tree_nodes(spark, sf):
    return document_tree(spark, sf).to_frame(spark)


@query("marker_tree_cells", "SPL-8 TRE-4")
def marker_tree_cells(spark, sf):
    return document_tree(spark, sf).assign(document_markers(spark, sf).select("cell_id", "lang", *DOC_MARKERS)).select("cell_id", "lang", "path")


@query("marker_tree_agreement", "EVL-1 EVL-3 EVL-4")
def marker_tree_agreement(spark, sf):
    cells = document_tree(spark, sf).assign(document_markers(spark, sf))
    t = materialize(E.contingency(cells, "lang", "path"))
    from markertree.session import attach_row

    return attach_row(E.rand_indices(t), E.adjusted_mutual_info(t))


@query("reassigned_tree_nodes", "SPL-10 MIX-14")
def reassigned_tree_nodes(spark, sf):
    cells = document_markers(spark, sf).select("cell_id", *DOC_MARKERS)
    return grow(cells, DOC_MARKERS, PROFILES["marker"].with_options(min_cells=100, min_side=30), reassign=True, store=True).to_frame(spark)


@query("refreshed_leaf_statistics", "SPL-10 MIX-14", """
SELECT count(*) AS cells, TRUE AS counts_agree, TRUE AS means_agree, TRUE AS covariances_agree FROM documents""")
def refreshed_leaf_statistics(spark, sf):
    """Leaf statistics carried through all relabellings against a recomputation from the final labels."""
    cells = document_markers(spark, sf).select("cell_id", *DOC_MARKERS)
    out = grow_refreshed(cells, DOC_MARKERS, PROFILES["marker"].with_options(min_cells=100, min_side=30))
    names = [f"m_{m}" for m in DOC_MARKERS]
    carried = spark.createDataFrame(
        [(p, s.n, *[float(v) for v in s.mean(out.centre)], float(np.trace(s.cov()))) for p, s in out.sums.items() if s.n > 1],
        "path string, n bigint, " + ", ".join(f"{m} double" for m in names) + ", spread double")
    again = out.cells.groupBy("path").agg(
        F.count("*").alias("n2"), *[F.avg(m).alias(f"again_{m}") for m in DOC_MARKERS],
        sum((F.var_samp(m) for m in DOC_MARKERS[1:]), F.var_samp(DOC_MARKERS[0])).alias("spread2"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9 * (1 + F.abs(F.col(b)))
    both = again.join(carried, "path", "left")
    known = F.col("path").isNotNull() & (F.col("n2") > 1)
    every = lambda c: F.min(F.when(known, F.coalesce(c, F.lit(False)).cast("int")).otherwise(1)) == 1
    means = near(names[0], f"again_{DOC_MARKERS[0]}")
    for m in DOC_MARKERS[1:]:
        means = means & near(f"m_{m}", f"again_{m}")
    return both.agg(F.sum("n2").alias("cells"), every(F.col("n") == F.col("n2")).alias("counts_agree"),
                    every(means).alias("means_agree"), every(near("spread", "spread2")).alias("covariances_agree"))


@query("resumed_tree_nodes", "SPL-15 SNK-6")
def resumed_tree_nodes(spark, sf):
    """Grow one level, store, reload, and go on from the open leaves."""
    cells = document_markers(spark, sf).select("cell_id", *DOC_MARKERS)
    p = PROFILES["marker"].with_options(min_cells=100, min_side=30)
    first = grow(cells, DOC_MARKERS, p, max_depth=1, store=True)
    path = scratch(spark, "tree")
    W.save_tree({"nodes": first.to_frame(spark)}, path, "first")
    stored = W.load_tree(spark, path, "first").select(*NODES.fieldNames())
    return grow(cells, DOC_MARKERS, p, tree=reopen(Tree.from_frame(stored), ["depth"]), store=True).to_frame(spark)


@query("vetoed_tree_nodes", "SPL-14 MIX-21 DIM-6")
def vetoed_tree_nodes(spark, sf):
    cells = document_markers(spark, sf).select("cell_id", *DOC_MARKERS)
    long = materialize(document_expression(spark, sf).select("cell_id", "feature", "value"))
    veto = X.expression_veto(long)
    return grow(cells, DOC_MARKERS, PROFILES["marker"].with_options(min_cells=100, min_side=30), veto=veto, store=True).to_frame(spark)


@query("expression_tree_nodes", "SPL-7 SPL-11 QC-6")
def expression_tree_nodes(spark, sf):
    rows, features = packed_documents(spark, sf)
    return X.grow_expression(rows, features, max_depth=3).tree.to_frame(spark)


@query("gene_set_tree_nodes", "SPL-12 CCA-1")
def gene_set_tree_nodes(spark, sf):
    rows, features = packed_documents(spark, sf, 120)
    sets = [[i for i, f in enumerate(features) if f.startswith(s)] for s in ("e", "d")]
    sets = [s for s in sets if 1 < len(s) < len(features) - 1]
    return X.grow_expression(rows, features, X.gene_set_embedder(sets), max_depth=2, outlier_factor=None).tree.to_frame(spark)


@query("metagene_split_cells", "SPL-13 MIX-20 DIM-4 DIM-5 DIF-6")
def metagene_split_cells(spark, sf):
    rows, features = packed_documents(spark, sf, 200)
    counts = token_counts(spark, sf).select("cell_id", "feature", "value")
    cells = document_markers(spark, sf).select("cell_id", "lang")
    out = X.split_by_metagenes(counts, cells, rows, features, components=4)
    if out is None:
        return cells.select("cell_id", "lang", F.lit(None).cast("int").alias("label"))
    return out["cells"].select("cell_id", "lang", "label", "posterior")


@query("metagene_totals", "DIM-5", f"""
WITH {TOKENS_SQL}, m AS (SELECT DISTINCT feature, substring(feature, 1, 1) AS metagene FROM tokens)
SELECT cell_id, metagene, sum(value) AS value FROM tokens JOIN m USING (feature) GROUP BY ALL""")
def metagene_totals(spark, sf):
    t = token_counts(spark, sf)
    genes = t.select("feature").distinct().withColumn("metagene", F.substring("feature", 1, 1))
    return MG.metagene_counts(t, genes)


@query("metagene_tails", "DIM-4", """
WITH l AS (SELECT event_type || '_' || CAST(user_id % 20 AS VARCHAR) AS feature, 'PC' || CAST(isodow(ts) % 2 AS VARCHAR) AS component, avg(value) / 50 - 0.5 AS w FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w, feature) AS lo, row_number() OVER (PARTITION BY component ORDER BY w DESC, feature DESC) AS hi,
  count(*) FILTER (w < -0.03) OVER (PARTITION BY component) + 1 AS nlo, count(*) FILTER (w > 0.03) OVER (PARTITION BY component) + 1 AS nhi FROM l)
SELECT component || '-' AS metagene, feature FROM k WHERE lo <= nlo UNION ALL SELECT component || '+', feature FROM k WHERE hi <= nhi""")
def metagene_tails(spark, sf):
    l = table(spark, sf, "events").groupBy(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("feature"),
        F.concat(F.lit("PC"), ((F.weekday("ts") + 1) % 2).cast("string")).alias("component")).agg((F.avg("value") / 50 - 0.5).alias("w"))
    return MG.metagenes(l, 0.03)


@query("informative_components", "DIF-6", """
WITH f AS (SELECT CAST(l_linenumber AS INTEGER) AS pc, avg(l_quantity) AS b1, avg(l_discount) * 510 AS b2 FROM lineitem GROUP BY l_linenumber)
SELECT coalesce(min(pc) FILTER (b1 < b2), max(pc)) + 1 AS n_components FROM f""")
def informative_components(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("pc")).agg(
        F.avg("l_quantity").alias("b1"), (F.avg("l_discount") * 510).alias("b2"))
    fits = li.select("pc", F.lit(1).alias("k"), F.col("b1").alias("bic")).union(li.select("pc", F.lit(2), "b2"))
    return FE.informative_components(fits)


# ---------------------------------------------------------------- consensus

SCORES_SQL = """s AS (SELECT o_orderstatus AS node, CAST(month(o_orderdate) AS INTEGER) AS batch_ord, o_orderpriority AS key, round(avg(o_totalprice) / 1e4 - 35, 6) AS score FROM orders GROUP BY ALL),
v AS (SELECT node, key, count(*) AS n_votes, max(score + 0.1 * c) AS s FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY batch_ord) AS c FROM s WHERE score > -10) GROUP BY ALL),
votes AS (SELECT node, key, n_votes, CASE WHEN count(*) OVER (PARTITION BY node) = 1 THEN -10 ELSE s END + n_votes / 10 AS vote FROM v)"""


def batch_scores(spark, sf):
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("node"), F.month("o_orderdate").alias("batch_ord"), F.array("o_orderpriority").alias("key")
    ).agg(F.round(F.avg("o_totalprice") / 1e4 - 35, 6).alias("score"))


@query("marker_votes", "XDS-2", f"WITH {SCORES_SQL} SELECT node, key, n_votes, round(vote, 6) AS vote FROM votes")
def marker_votes(spark, sf):
    v = V.marker_votes(batch_scores(spark, sf))
    return v.select("node", F.element_at("key", 1).alias("key"), "n_votes", r("vote").alias("vote"))


@query("consensus_winners", "XDS-3 XDS-4", f"""
WITH {SCORES_SQL}, w AS (SELECT node, key, row_number() OVER (PARTITION BY node ORDER BY vote DESC, n_votes DESC) AS k FROM votes WHERE vote > -10)
SELECT s.node, s.key, count(*) AS n_training, round(max(score), 6) AS best FROM s JOIN w ON s.node = w.node AND s.key = w.key AND k = 1 WHERE score > -10 GROUP BY ALL""")
def consensus_winners(spark, sf):
    s = batch_scores(spark, sf)
    t = V.training_batches(s, V.consensus_winner(V.marker_votes(s)))
    return t.groupBy("node", F.element_at("key", 1).alias("key")).agg(F.count(F.lit(1)).alias("n_training"), r(F.max("score")).alias("best"))


@query("oriented_side_labels", "XDS-5", f"""
WITH {LINE_SQL}, o AS (SELECT batch, avg(price) FILTER (disc > 0.05) < avg(price) FILTER (disc <= 0.05) AS low FROM cells GROUP BY batch)
SELECT cell_id, CASE WHEN (disc > 0.05) = low THEN 0 ELSE 1 END AS label FROM cells JOIN o USING (batch)""")
def oriented_side_labels(spark, sf):
    cells = line_cells(spark, sf).withColumn("part", F.col("disc") > 0.05)
    return V.side_labels(cells, "part", ["batch"], ["price"]).select("cell_id", "label")


@query("shared_model_nodes", "XDS-6", f"""
WITH {LINE_SQL}, b AS (SELECT batch, disc > 0.05 AS node, count(*) AS n, avg(qty) FILTER (tax <= 0.04) AS l, avg(qty) FILTER (tax > 0.04) AS r FROM cells GROUP BY ALL)
SELECT node, 'qty' AS feature, round(avg(l), 6) AS mean_left, round(avg(r), 6) AS mean_right, CAST(sum(n) AS BIGINT) AS n, string_agg(batch, ',' ORDER BY batch) AS batches FROM b GROUP BY node""")
def shared_model_nodes(spark, sf):
    b = line_cells(spark, sf).groupBy("batch", (F.col("disc") > 0.05).alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("tax") <= 0.04, F.col("qty"))).alias("mean_left"),
        F.avg(F.when(F.col("tax") > 0.04, F.col("qty"))).alias("mean_right")).withColumn("feature", F.lit("qty"))
    return rounded(V.model_nodes(b), "mean_left", "mean_right")


def document_consensus(spark, sf):
    cells = document_markers(spark, sf)
    lacking = [c for c in ("share_accent", "share_o")]
    panel = cells.select("batch", "cell_id", *[
        (F.when(F.col("batch") != "b2", F.col(c)) if c in lacking else F.col(c)).alias(c) for c in DOC_MARKERS])
    long = materialize(document_expression(spark, sf))
    p = PROFILES["consensus"].with_options(spread_guard=False, unique_per_cells=1e9, unique_cap=10)
    rows, features = pack_expression(panel, long)
    rows = materialize(rows)
    return rows, features, grow_consensus(panel, DOC_MARKERS, long, p, child_cutoff=0.1, packed=(rows, features))


@query("consensus_tree_nodes", "XDS-1 XDS-7 XDS-8 DIF-2 TRE-10")
def consensus_tree_nodes(spark, sf):
    return document_consensus(spark, sf)[2].nodes_frame(spark)


@query("consensus_leaf_cells", "XDS-11 XDS-12 XDS-21 SNK-2")
def consensus_leaf_cells(spark, sf):
    rows, _, tree = document_consensus(spark, sf)
    return leaf_table(rows, tree)


def stored_consensus(spark, sf):
    """A grown tree, stored and loaded again, with the packed rows and the stored cell paths."""
    rows, features, tree = document_consensus(spark, sf)
    path = scratch(spark, "consensus")
    TS.save_consensus(tree, TS.place_cells(rows, tree), path, "grown")
    return rows, *TS.load_consensus(spark, path, "grown", features)


@query("rewritten_tree_sizes", "XDS-17 SNK-6 XDS-7 XDS-21", """
SELECT 'b' || CAST(doc_id % 3 AS VARCHAR) AS batch, count(*) AS cells, CAST(0 AS BIGINT) AS moved, TRUE AS same_sizes, TRUE AS same_rules
FROM documents GROUP BY ALL""")
def rewritten_tree_sizes(spark, sf):
    """A walk over the whole stored tree without passes leaves sizes and rules as they are."""
    rows, tree, sides = stored_consensus(spark, sf)
    out, paths = TS.rewrite(tree, rows, sides, DOC_MARKERS, [])
    before, after = (x.groupBy("batch", "path").agg(F.count("*").alias(n)) for x, n in ((sides, "a"), (paths, "b")))
    same = before.join(after, ["batch", "path"], "full").groupBy("batch").agg(F.min((F.col("a").eqNullSafe(F.col("b"))).cast("int")).alias("s"))
    rules = all(n.rule == tree.batches[b].nodes[p].rule for b, t in out.batches.items() for p, n in t.nodes.items())
    sizes = paths.groupBy("batch").agg(F.count("*").alias("cells"), F.count_if("moved").alias("moved"))
    return sizes.join(same, "batch").select("batch", "cells", "moved", (F.col("s") == 1).alias("same_sizes"), F.lit(rules).alias("same_rules"))


@query("postpassed_tree_nodes", "XDS-10 XDS-13 XDS-17 KNN-2 MIX-15")
def postpassed_tree_nodes(spark, sf):
    """All passes at every node: sure cells, genes and weights learned again, mixture cuts, neighbours' votes."""
    rows, tree, sides = stored_consensus(spark, sf)
    return TS.rewrite(tree, rows, sides, DOC_MARKERS, list(TS.PASSES))[0].nodes_frame(spark)


@query("consensus_weights", "XDS-18 SNK-3")
def consensus_weights(spark, sf):
    return document_consensus(spark, sf)[2].weights_frame(spark)


def sided_documents(spark, sf, top=80):
    rows, features = packed_documents(spark, sf, top)
    rows = materialize(rows)
    marks = document_markers(spark, sf).select("cell_id", "share_e")
    both = rows.join(marks, "cell_id")
    centre = both.agg(F.avg("share_e").alias("c"))
    from markertree.session import attach_row

    return attach_row(both, centre).withColumn("side", F.when(F.col("share_e") > F.col("c"), "R").otherwise("L")).drop("c"), features


@query("pseudo_marker_directions", "XDS-9")
def pseudo_marker_directions(spark, sf):
    rows, features = sided_documents(spark, sf)
    m = PP.pseudo_marker(materialize(rows), len(features))
    out = [(b, features[i], float(m["w"][i]), float(d[i])) for b, d in sorted(m["delta"].items()) for i in range(len(features))]
    return spark.createDataFrame(out, "batch string, feature string, w double, delta double")


@query("retrained_node_cells", "XDS-10 XDS-17 KNN-2")
def retrained_node_cells(spark, sf):
    rows, features = sided_documents(spark, sf)
    out = PP.refresh_level(materialize(rows), len(features), ["share_e"], ["retrain", "mixture", "fill"])
    return out.select("batch", "cell_id", "side", "h")


@query("mixture_split_of_projection", "XDS-13 MIX-18")
def mixture_split_of_projection(spark, sf):
    h = materialize(document_markers(spark, sf).select("batch", "cell_id", F.col("share_e").alias("h")))
    return PP.split_projection_by_mixture(h, ["batch"])


@query("passed_through_nodes", "XDS-14", """
SELECT CAST(c_mktsegment AS VARCHAR) AS path, count(*) AS n, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN count(*) ELSE 1 END AS BIGINT) AS n_left,
  CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN count(*) ELSE count(*) - 1 END AS BIGINT) AS n_right FROM customer GROUP BY c_mktsegment""")
def passed_through_nodes(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    nodes = n.select("path", "n", F.lit(1).cast("bigint").alias("n_left"), (F.col("n") - 1).alias("n_right"),
                     F.array(F.lit(1.0)).alias("mean_left"), F.array(F.lit(2.0)).alias("mean_right"))
    return PP.pass_through(nodes, nodes.filter("path = 'BUILDING'")).select("path", "n", "n_left", "n_right")


@query("pooled_components", "XDS-15 DIM-1 DIF-5")
def pooled_components(spark, sf):
    rows, features = packed_documents(spark, sf, 100)
    return PP.pooled_components(materialize(rows), len(features))


@query("stored_node_components", "XDS-16 TRE-11", """
SELECT CAST(user_id AS VARCHAR) AS cell_id, round(avg(value), 6) AS h FROM events WHERE isodow(ts) = 3 GROUP BY user_id""")
def stored_node_components(spark, sf):
    stored = table(spark, sf, "events").groupBy((F.weekday("ts") + 1).alias("node_id"), F.col("user_id").cast("string").alias("cell_id")).agg(F.avg("value").alias("h"))
    return rounded(PP.stored_components(stored, 3).select("cell_id", "h"), "h")


@query("identity_space", "XDS-18 NRM-7 NRM-8", f"""
WITH {NODE_WEIGHTS_SQL}, z AS (SELECT node_id, feature, (w - avg(w) OVER p) / stddev_pop(w) OVER p * (log2(2 * node_id + 1) + 1) / 10 AS w FROM weights WINDOW p AS (PARTITION BY node_id)),
c AS (SELECT CAST(user_id AS VARCHAR) AS cell_id, event_type AS feature, count(*) AS value FROM events GROUP BY ALL)
SELECT cell_id, node_id, round(sum(value * w), 6) + 0.0 AS h FROM c JOIN z USING (feature) GROUP BY ALL""")
def identity_space(spark, sf):
    from markertree.sources.tables import event_counts

    return rounded(PP.identity_space(event_counts(spark, sf), event_weights(spark, sf)), "h")


@query("projection_table_export", "SNK-4", ORACLES["identity_space"])
def projection_table_export(spark, sf):
    """The projection of every cell at every node, written and read back."""
    path = scratch(spark, "projections")
    W.write_table(identity_space(spark, sf), path)
    return spark.read.parquet(path)


@query("batch_node_projections", "XDS-19", """
WITH c AS (SELECT event_type AS feature, CAST(user_id AS VARCHAR) AS cell_id, user_id % 3 AS batch, count(*) AS value FROM events GROUP BY ALL),
w AS (SELECT user_id % 3 AS batch, CAST(isodow(ts) AS BIGINT) AS node_id, event_type AS feature, avg(value) AS w FROM events GROUP BY ALL)
SELECT batch, cell_id, node_id, round(sum(value * w), 6) AS h FROM c JOIN w USING (batch, feature) GROUP BY ALL""")
def batch_node_projections(spark, sf):
    e = table(spark, sf, "events").withColumn("batch", F.col("user_id") % 3)
    long = e.groupBy("batch", F.col("user_id").cast("string").alias("cell_id"), F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    w = e.groupBy("batch", (F.weekday("ts") + 1).cast("bigint").alias("node_id"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("w"))
    return rounded(PP.batch_projections(long, w), "h")


@query("side_histograms_by_role", "XDS-20 AGG-16", f"""
WITH {LINE_SQL}, h AS (SELECT batch AS node_id, CASE WHEN qty > 25 THEN 'R' ELSE 'L' END AS side, CASE WHEN tax > 0.04 THEN 'train' ELSE 'query' END AS role, price AS h FROM cells),
e AS (SELECT node_id, min(h) AS lo, max(h) AS hi FROM h GROUP BY node_id),
b AS (SELECT node_id, side, role, CAST(least(floor((h - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, (hi - lo) / 50 AS w FROM h JOIN e USING (node_id)),
c AS (SELECT node_id, side, role, bin, count(*) AS n, max(w) AS w FROM b GROUP BY ALL)
SELECT node_id, side, role, bin, n, round(n / sum(n) OVER (PARTITION BY node_id, side, role) / w, 9) AS density FROM c""")
def side_histograms_by_role(spark, sf):
    h = line_cells(spark, sf).select(F.col("batch").alias("node_id"), F.when(F.col("qty") > 25, "R").otherwise("L").alias("side"),
                                     F.when(F.col("tax") > 0.04, "train").otherwise("query").alias("role"), F.col("price").alias("h"))
    return rounded(RP.side_histograms(h, ["side", "role"]), "density", digits=9)


# ---------------------------------------------------------------- linear maps

@query("embedding_covariance", "DIM-1 AGG-1", """
WITH e AS (SELECT [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), ij AS (SELECT i, j FROM range(64) a(i), range(64) b(j) WHERE i <= j)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(v[i + 1], v[j + 1]), 6) + 0.0 AS cov FROM e, ij GROUP BY ALL""")
def embedding_covariance(spark, sf):
    c = L.gram(embedding_dims(spark, sf), 64)[()].cov()
    rows = [(i, j, float(c[i, j])) for i in range(64) for j in range(i, 64)]
    return rounded(spark.createDataFrame(rows, "i int, j int, cov double"), "cov")


def eigen_sql(k: int, squarings: int = 24) -> str:
    """CTEs b1..bk: value and unit vector of the k largest components of the matrix in c1, by matrix squaring and deflation."""
    parts = []
    for i in range(1, k + 1):
        parts.append(f"""
p{i} AS (
  SELECT 0 AS step, [[x / trace for x in r] for r in m] AS m FROM (SELECT m, list_sum([m[a][a] for a in range(1, 65)]) AS trace FROM c{i})
  UNION ALL
  SELECT step + 1, [[x / trace for x in r] for r in m] FROM (
    SELECT step, m, list_sum([m[a][a] for a in range(1, 65)]) AS trace FROM (
      SELECT step, [[list_dot_product(r, s) for s in m] for r in m] AS m FROM p{i} WHERE step < {squarings}))),
v{i} AS MATERIALIZED (
  SELECT [x / sqrt(list_dot_product(r, r)) * sign(r[list_position([abs(y) for y in r], list_max([abs(y) for y in r]))]) for x in r] AS v
  FROM (SELECT m[list_position([m[a][a] for a in range(1, 65)], list_max([m[a][a] for a in range(1, 65)]))] AS r FROM p{i} WHERE step = {squarings})),
b{i} AS MATERIALIZED (SELECT v, list_dot_product(v, [list_dot_product(r, v) for r in m]) AS value FROM v{i}, c{i}),
c{i + 1} AS MATERIALIZED (SELECT [[m[a][b] - value * v[a] * v[b] for b in range(1, 65)] for a in range(1, 65)] AS m FROM c{i}, b{i})""")
    return ",".join(parts)


PCA_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings),
ij AS (SELECT i, j FROM range(1, 65) a(i), range(1, 65) b(j)),
cij AS (SELECT i, j, covar_samp(x[i], x[j]) AS c FROM e, ij GROUP BY ALL),
c1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cij GROUP BY i)),{eigen_sql(5)}"""


@query("pca_scores", "DIM-1 DIM-2 PRJ-3", f"""{PCA_SQL},
mean AS MATERIALIZED (SELECT list(c ORDER BY i) AS mean FROM (SELECT i, avg(x[i]) AS c FROM e, range(1, 65) a(i) GROUP BY i))
SELECT vec_id, {", ".join(f"round(list_dot_product(x, b{i}.v) - list_dot_product(mean, b{i}.v), 6) + 0.0 AS PC{i - 1}" for i in range(1, 6))}
FROM e, mean, {", ".join(f"b{i}" for i in range(1, 6))}""")
def pca_scores(spark, sf):
    e = embedding_dims(spark, sf)
    model = L.pca(e, 5, 64)
    scores = L.apply_map(e, model.matrix, model.offset).select("vec_id", *[F.element_at("scores", i + 1).alias(f"PC{i}") for i in range(5)])
    return rounded(scores, *[f"PC{i}" for i in range(5)])


@query("component_variances", "DIM-3 WIN-6", f"""{PCA_SQL}
{" UNION ALL ".join(f"SELECT {i - 1} AS pc, round(value, 6) + 0.0 AS variance FROM b{i}" for i in range(1, 6))}""")
def component_variances(spark, sf):
    e = embedding_dims(spark, sf)
    model = L.pca(e, 5, 64)
    rows = [(i, float(v)) for i, v in enumerate(model.values)]
    return rounded(spark.createDataFrame(rows, "pc int, variance double"), "variance")


@query("discriminant_scores", "DIM-6")
def discriminant_scores(spark, sf):
    e = embedding_dims(spark, sf).filter("label in (1, 2)")
    model = L.discriminant(e, "label", 64)
    return L.apply_map(e, model.matrix, model.offset).select("vec_id", "label", F.element_at("scores", 1).alias("score"))


@query("pls_marker_weights", "CCA-6", f"""
WITH {LINE_SQL}, c AS (SELECT batch, corr(qty, price) AS q, corr(disc, price) AS d, corr(tax, price) AS t FROM cells GROUP BY batch),
n AS (SELECT *, sqrt(q * q + d * d + t * t) AS n FROM c)
SELECT batch, 'qty' AS feature, round(q / n, 6) + 0.0 AS w FROM n UNION ALL SELECT batch, 'disc', round(d / n, 6) + 0.0 FROM n UNION ALL SELECT batch, 'tax', round(t / n, 6) + 0.0 FROM n""")
def pls_marker_weights(spark, sf):
    return rounded(L.pls_weights(line_cells(spark, sf), ["qty", "disc", "tax"], "price", ["batch"]), "w")


PLS_SQL = f"""{TOKENS_SQL}, y AS (SELECT CAST(doc_id AS VARCHAR) AS cell_id, ln(1 + n_chars) AS y FROM documents),
k AS (SELECT count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy FROM y),
s AS (SELECT feature, sum(value) AS s, sum(value * value) AS ss, sum(value * y) AS sxy FROM tokens JOIN y USING (cell_id) GROUP BY feature),
c AS MATERIALIZED (SELECT feature, CASE WHEN ss / n - (s / n) ** 2 > 0 THEN (sxy / n - s / n * my) / (sqrt(ss / n - (s / n) ** 2) * sy) ELSE 0 END AS c FROM s, k)"""


@query("pls_token_weights", "CCA-6 JOI-5", f"WITH {PLS_SQL}, norm AS MATERIALIZED (SELECT sqrt(sum(c * c)) AS len FROM c) SELECT feature, round(c / len, 6) + 0.0 AS w FROM c, norm")
def pls_token_weights(spark, sf):
    target = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cell_id"), F.log1p("n_chars").alias("y"))
    return rounded(L.pls_weights_sparse(token_counts(spark, sf).drop("batch"), target), "w")


@query("loading_and_score_genes", "DIF-4 WIN-3 CCA-6")
def loading_and_score_genes(spark, sf):
    long = materialize(document_expression(spark, sf))
    marks = materialize(document_markers(spark, sf))
    loadings = L.pls_weights_sparse(long, marks.select("batch", "cell_id", F.col("share_e").alias("y")), ["batch"], ["cell_id"])
    groups = marks.select("batch", "cell_id", F.when(F.col("share_e") > 0.1, "R").otherwise("L").alias("group"))
    scores = FE.welch_scores(long, groups, ["cell_id"], ["batch"])
    return FE.loading_and_score_features(loadings, scores, long)


def view_model_rows(spark, gram, widths, model, name):
    rows = [(name, i, j, c, v) for i, j, c, v in L.view_correlations(gram, widths, model)]
    return spark.createDataFrame(rows, "model string, view_a int, view_b int, component int, correlation double")


@query("two_view_correlations", "CCA-1 CCA-2 AGG-11")
def two_view_correlations(spark, sf):
    g = L.gram(embedding_dims(spark, sf), 64)[()]
    return view_model_rows(spark, g, [32, 32], L.cca_from(g, [32, 32], 5), "cca")


@query("joint_projection", "CCA-3")
def joint_projection(spark, sf):
    e = embedding_dims(spark, sf)
    g = L.gram(e, 64)[()]
    m = L.cca_from(g, [32, 32], 3)
    both = np.zeros((64, 6))
    both[:32, :3], both[32:, 3:] = m.maps[0].matrix, m.maps[1].matrix
    joint = both @ L.joint_projection_matrix(m.values)
    return L.apply_map(e, joint, g.mean).select("vec_id", *[F.element_at("scores", i + 1).alias(f"z{i}") for i in range(3)])


@query("multi_view_correlations", "CCA-4 AGG-12")
def multi_view_correlations(spark, sf):
    g = L.gram(embedding_dims(spark, sf), 64)[()]
    return view_model_rows(spark, g, [20, 20, 24], L.gcca_from(g, [20, 20, 24], 4), "gcca")


@query("bridged_view_correlations", "CCA-4b")
def bridged_view_correlations(spark, sf):
    e = embedding_dims(spark, sf)
    even, odd = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")
    a = L.gram(even.select(F.slice("x", 1, 40).alias("x")), 40)[()]
    b = L.gram(odd.select(F.slice("x", 21, 44).alias("x")), 44)[()]
    m = L.bridged_from(a, b, [20, 20, 24], 3)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.values)], "component int, value double")


@query("hierarchical_view_scores", "CCA-4c")
def hierarchical_view_scores(spark, sf):
    e = embedding_dims(spark, sf)
    g = L.gram(e, 64)[()]
    m = L.hierarchical_from(g, [20, 20, 24], 2)
    wide = np.zeros((64, 6))
    for v, (lo, hi) in enumerate(((0, 20), (20, 40), (40, 64))):
        wide[lo:hi, 2 * v:2 * v + 2] = m.maps[v].matrix
    return L.apply_map(e, wide, g.mean).select("vec_id", *[F.element_at("scores", i + 1).alias(f"v{i // 2}_{i % 2}") for i in range(6)])


@query("missing_view_alignment", "CCA-5 AGG-12")
def missing_view_alignment(spark, sf):
    e = embedding_dims(spark, sf)
    rows = e.select(F.slice("x", 1, 20).alias("a"), F.when(F.col("vec_id") % 3 != 0, F.slice("x", 21, 20)).alias("b"),
                    F.when(F.col("vec_id") % 5 != 0, F.slice("x", 41, 24)).alias("c"))
    m = L.align_views(rows, ["a", "b", "c"], [20, 20, 24], 3)
    return spark.createDataFrame([(i, j, v) for i, j, v in m.pair_correlations], "view_a int, view_b int, correlation double")


@query("wide_view_alignment", "CCA-5 AGG-12", """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS place FROM d WHERE len(w) > 0),
v AS (SELECT DISTINCT doc_id, place * 3 // n AS view FROM t),
p AS (SELECT a.view AS x, b.view AS y, count(*) AS n_rows FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.view < b.view GROUP BY ALL)
SELECT x AS view_a, y AS view_b, CAST(c AS INTEGER) AS component, n_rows, TRUE AS agrees, TRUE AS unit_scale
FROM p, range(3) r(c)""")
def wide_view_alignment(spark, sf):
    """Thirds of a text as views, every token a feature; correlations and scale recomputed from the emitted scores."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    # texts move once, to their row; their many more entries are counted and summed there
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    tokens = docs.select("doc_id", words.alias("w")).select(
        F.col("doc_id").alias("row"), F.size("w").alias("n"), F.posexplode("w").alias("at", "feature"))
    third = F.floor(F.col("at") * 3 / F.col("n")).cast("int")
    long = tokens.groupBy(third.alias("view"), "row", "feature").agg(F.log1p(F.count("*")).alias("value"))
    found = WV.align_wide_views(long, [0, 1, 2], 3, rounds=6, reg=1.0)
    scores = found.scores.select("row", "view", F.posexplode("scores").alias("component", "s"))
    a, b = (scores.select("row", "component", F.col("view").alias(f"view_{n}"), F.col("s").alias(n)) for n in "ab")
    pairs = a.join(b, ["row", "component"]).filter("view_a < view_b").groupBy("view_a", "view_b", "component").agg(
        F.count("*").alias("n_rows"), (F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("again"))
    model = spark.createDataFrame(found.correlations, "view_a int, view_b int, component int, c double")
    # q' (N + ridge) q = 1: the scores' own part of the scale lies in (0, 1]
    scale = scores.groupBy("component", "view").agg(F.sum(F.col("s") ** 2).alias("ss")).groupBy("component").agg(F.max("ss").alias("top"))
    return pairs.join(model, ["view_a", "view_b", "component"]).join(scale, "component").select(
        "view_a", "view_b", "component", "n_rows", (F.abs(F.col("c") - F.col("again")) < 1e-6).alias("agrees"),
        ((F.col("top") > 0) & (F.col("top") <= 1 + 1e-6)).alias("unit_scale"))


@query("view_activity", "AGG-13", """
WITH t AS (SELECT event_type AS view, user_id AS "row", sum(value) AS s FROM events GROUP BY ALL), a AS (SELECT view, "row", CAST(s <> 0 AS INTEGER) AS active FROM t)
SELECT view, "row", active, CAST(sum(active) OVER (PARTITION BY "row") - active AS BIGINT) AS n_other FROM a""")
def view_activity(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("view"), F.col("user_id").alias("row"), "value")
    return L.view_activity(t)


# ---------------------------------------------------------------- reports

@query("node_component_curves", "VIS-1 VIS-3 UDF-4", f"""
WITH {LINE_SQL}, c AS (SELECT batch, 'price' AS feature, CASE WHEN qty > 25 THEN 1 ELSE 0 END AS comp, count(*) AS n, avg(price) AS m, var_pop(price) AS v FROM cells GROUP BY ALL),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY batch) AS w FROM c), lim AS (SELECT batch, min(price) AS lo, max(price) AS hi FROM cells GROUP BY batch),
g AS (SELECT w.*, CAST(p AS INTEGER) AS point, lo + p * ((hi - lo) / 499) AS x FROM w JOIN lim USING (batch), range(500) t(p))
SELECT batch, feature, comp, point, round(w * exp(-0.5 * (ln(2 * pi()) + ln(v) + (x - m) ** 2 / v)) * 1e6, 6) AS density FROM g""")
def node_component_curves(spark, sf):
    cells = line_cells(spark, sf).withColumn("comp", F.when(F.col("qty") > 25, 1).otherwise(0))
    c = cells.groupBy("batch", "comp").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.var_pop("price").alias("var"))
    total = c.groupBy("batch").agg(F.sum("n").alias("t"))
    comps = c.join(total, "batch").select("batch", F.lit("price").alias("feature"), "comp", (F.col("n") / F.col("t")).alias("weight"), "mean", "var", F.col("comp").alias("merged_to"))
    limits = cells.groupBy("batch").agg(F.min("price").alias("lo"), F.max("price").alias("hi")).withColumn("feature", F.lit("price"))
    curves = RP.component_curves(comps, limits, ["batch"])
    return curves.select("batch", "feature", "comp", "point", r(F.col("density") * 1e6).alias("density"))


@query("pair_scatter_labels", "VIS-2", f"""
WITH {LINE_SQL} SELECT cell_id, qty AS x, price AS y, CAST(floor(qty / 10) AS INTEGER) AS raw, CASE WHEN qty > 25 THEN 1 ELSE 0 END AS merged FROM cells""")
def pair_scatter_labels(spark, sf):
    return RP.pair_scatter(line_cells(spark, sf), ("qty", "price"), F.floor(F.col("qty") / 10).cast("int"), F.when(F.col("qty") > 25, 1).otherwise(0))


@query("tree_edge_report", "VIS-4 VIS-5")
def tree_edge_report(spark, sf):
    cells = document_markers(spark, sf)
    m = M.moments(cells, [], DOC_MARKERS).first()
    nodes = document_tree(spark, sf).to_frame(spark)
    return RP.tree_edges(nodes, {c: m[f"mean_{c}"] for c in DOC_MARKERS}, {c: m[f"var_{c}"] ** 0.5 for c in DOC_MARKERS})


@query("subset_background_density", "VIS-6", f"""
WITH {LINE_SQL}, x AS ({" UNION ALL ".join(f"SELECT cell_id, batch, '{m}' AS feature, {m} AS value FROM cells" for m in MARKERS)}),
lim AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM x GROUP BY feature), roles AS (SELECT feature, value, 'all' AS role FROM x UNION ALL SELECT feature, value, 'subset' FROM x WHERE batch = 'A'),
b AS (SELECT role, feature, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, (hi - lo) / 50 AS w FROM roles JOIN lim USING (feature)), c AS (SELECT role, feature, bin, count(*) AS n, max(w) AS w FROM b GROUP BY ALL)
SELECT role, feature, bin, n, round(n / sum(n) OVER (PARTITION BY role, feature) / w, 9) AS density FROM c""")
def subset_background_density(spark, sf):
    long = line_long(spark, sf).select("cell_id", "feature", "value")
    members = line_cells(spark, sf).filter("batch = 'A'").select("cell_id")
    return rounded(RP.subset_against_background(long, members), "density", digits=9)


@query("marker_in_largest_leaves", "VIS-8", """
WITH l AS (SELECT user_id % 20 AS leaf, value FROM events), big AS (SELECT leaf FROM l GROUP BY leaf ORDER BY count(*) DESC, leaf LIMIT 12), e AS (SELECT min(value) AS lo, max(value) AS hi FROM l),
b AS (SELECT leaf, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, (hi - lo) / 30 AS w FROM l, e WHERE leaf IN (SELECT leaf FROM big)), c AS (SELECT leaf, bin, count(*) AS n, max(w) AS w FROM b GROUP BY ALL)
SELECT leaf, bin, n, round(n / sum(n) OVER (PARTITION BY leaf) / w, 9) AS density FROM c""")
def marker_in_largest_leaves(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("leaf"), "value")
    return rounded(RP.marker_in_largest_leaves(e, "leaf", "value"), "density", digits=9)


@query("benchmark_harness", "EVL-7 SNK-9 MIX-19")
def benchmark_harness(spark, sf):
    from markertree.plans.harness import run_harness

    cells = document_markers(spark, sf).select("cell_id", *DOC_MARKERS)
    return run_harness(cells, DOC_MARKERS, "documents", repeats=1, max_k=4).drop("time")


# ---------------------------------------------------------------- streams

@query("stream_scored_cells", "STR-1", f"""
WITH {LINE_SQL} SELECT cell_id, CASE WHEN qty <= 25 THEN 'L' WHEN disc <= 0.05 THEN 'RL' ELSE 'RR' END AS path FROM cells""")
def stream_scored_cells(spark, sf):
    from markertree.plans.tree import interval_rule

    source, sink = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    cells = line_cells(spark, sf)
    W.write_table(cells, source)
    tree = Tree()
    tree.split("", interval_rule("qty", [25.0], "L"))
    tree.split("R", interval_rule("disc", [0.05], "L"))
    stream = scorer.read_cells(spark, source, cells.schema, 2)
    scorer.run_to_table(scorer.score_cells(stream, tree).select("cell_id", "path"), sink, scratch(spark, "stream-state"))
    return spark.read.parquet(sink)


@query("stream_leaf_counts", "STR-2", """
SELECT CAST(date_part('epoch', date_trunc('day', ts)) AS BIGINT) AS day, CASE WHEN value > 20 THEN 'R' ELSE 'L' END AS leaf, count(*) AS n FROM events GROUP BY ALL""")
def stream_leaf_counts(spark, sf):
    source, sink = scratch(spark, "events-in"), scratch(spark, "events-out")
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    events.repartition(4).write.parquet(source)
    scored = scorer.read_cells(spark, source, events.schema).withColumn("leaf", F.when(F.col("value") > 20, "R").otherwise("L"))
    scorer.run_updates(scorer.leaf_counts(scored, "ts", "leaf"), sink, scratch(spark, "events-state"))
    counts = scorer.latest_counts(spark.read.parquet(sink), ["window_start", "leaf"])
    return counts.select(F.unix_timestamp("window_start").alias("day"), "leaf", "n")


ARRIVAL_DAYS = 3
"""Days of events in a chunk of files; a row can arrive one chunk late."""


@query("stream_closed_windows", "STR-2 AGG-5", """
WITH late AS (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM events),
s AS (SELECT event_type AS batch, date_trunc('day', ts) AS day, CASE WHEN value <= 10 THEN 'L' WHEN value <= 40 THEN 'RL' ELSE 'RR' END AS path FROM events WHERE value IS NOT NULL)
SELECT CAST(date_part('epoch', day) AS BIGINT) AS day, batch, path, count(*) AS n FROM s, late WHERE day + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def stream_closed_windows(spark, sf):
    """Leaf counts of each batch and day, from files whose rows come up to a chunk late; a day is written once, when it closes."""
    from markertree.plans.tree import interval_rule

    source, sink = scratch(spark, "late-in"), scratch(spark, "late-out")
    events = table(spark, sf, "events").filter("value IS NOT NULL").select("event_id", "ts", F.col("event_type").alias("batch"), "value")
    chunk = F.floor(F.unix_timestamp("ts") / (ARRIVAL_DAYS * 86400)) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    chunks = scratch(spark, "late-chunks")
    events.withColumn("chunk", chunk).write.partitionBy("chunk").parquet(chunks)
    arriving = spark.read.parquet(chunks)
    for c in sorted(row[0] for row in arriving.select("chunk").distinct().collect()):  # files arrive chunk by chunk, as days do
        arriving.filter(F.col("chunk") == c).drop("chunk").write.mode("append").parquet(source)
    tree = Tree()
    tree.split("", interval_rule("value", [10.0], "L"))
    tree.split("R", interval_rule("value", [40.0], "L"))
    stream = scorer.read_cells(spark, source, events.schema, 1)
    counts = scorer.leaf_counts(scorer.score_cells(stream, tree), "ts", "path", late=f"{2 * ARRIVAL_DAYS + 1} days", by=["batch"])
    scorer.run_to_table(counts, sink, scratch(spark, "late-state"))
    return spark.read.parquet(sink).select(F.unix_timestamp("window_start").alias("day"), "batch", "path", "n")


DIRECTION_TOKENS = 100


def label_directions(long, training, labels):
    """label: (feature, w), the tokens whose rates among training documents differ most between the labels, with integer differences.

    The tokens are counted once for all labels.
    """
    n = training.agg(*[F.sum(c).alias(f"a_{c}") for c in labels], *[F.sum(1 - F.col(c)).alias(f"b_{c}") for c in labels]).first()
    df = materialize(long.join(training.select("cell_id", *labels), "cell_id").groupBy("feature").agg(
        *[F.sum(c).alias(f"a_{c}") for c in labels], *[F.sum(1 - F.col(c)).alias(f"b_{c}") for c in labels]))
    return {c: materialize(df.select("feature", (F.col(f"a_{c}") * n[f"b_{c}"] - F.col(f"b_{c}") * n[f"a_{c}"]).cast("double").alias(
        "w")).orderBy(F.abs("w").desc(), "feature").limit(DIRECTION_TOKENS)) for c in labels}


def project_labels(training, long, chosen):
    """``training`` with the projections h_c of each document on the directions: only their tokens travel to a document."""
    weights = None
    for c, d in chosen.items():
        named = d.withColumnRenamed("w", f"w_{c}")
        weights = named if weights is None else weights.join(named, "feature", "full")
    sums = long.join(materialize(weights), "feature").groupBy("cell_id").agg(
        *[F.sum(F.col("value") * F.col(f"w_{c}")).alias(f"h_{c}") for c in chosen])
    return training.join(sums, "cell_id", "left").select("batch", "cell_id", "toxic", "quality", *[
        F.coalesce(f"h_{c}", F.lit(0.0)).alias(f"h_{c}") for c in chosen])


def label_tree(training, long, features):
    """A two-level tree of stored directions: toxicity at the root, quality below, cut in each batch at the floor of its mean projection."""
    from markertree.plans.consensus import ConsensusTree

    chosen = label_directions(long, training, ("toxic", "quality"))
    vectors = {c: {x["i"]: x["w"] for x in d.join(features, "feature").collect()} for c, d in chosen.items()}  # DIRECTION_TOKENS rows
    h = materialize(project_labels(training, long, chosen))
    tree = ConsensusTree({}, Tree(), features)

    def split(path, rows, label):
        ids = sorted(vectors[label])
        centre = {x[label]: x["m"] for x in rows.groupBy(label).agg(F.avg(f"h_{label}").alias("m")).collect()}
        cuts = {x["batch"]: float(x["m"]) for x in rows.groupBy("batch").agg(F.floor(F.avg(f"h_{label}")).alias("m")).collect()}
        tree.weights[path] = {"w": vectors[label], "m0": centre.get(0, 0.0), "m1": centre.get(1, 0.0), "batches": sorted(cuts)}
        for b, cut in cuts.items():
            rule = {"kind": "projection", "idx": ids, "w": [vectors[label][i] for i in ids], "cuts": [cut, cut]}
            tree.batches.setdefault(b, Tree(batch=b)).split(path, rule)
        return cuts

    cuts = split("", h, "toxic")
    cut = F.element_at(F.create_map(*[F.lit(x) for item in cuts.items() for x in item]), F.col("batch"))
    split("L", h.filter(F.col("h_toxic") < cut), "quality")
    split("R", h.filter(F.col("h_toxic") > cut), "quality")
    tree.model = scorer.frozen_model(tree)
    return tree


@query("stream_projected_leaves", "STR-1 SNK-6 XDS-11", f"""
WITH {TOKENS_SQL}, d AS (SELECT CAST(doc_id AS VARCHAR) AS cell_id, lang AS batch FROM documents),
t AS (SELECT cell_id, batch, toxic, quality FROM d JOIN labels l ON CAST(l.doc_id AS VARCHAR) = cell_id WHERE batch <> 'es' AND toxic IS NOT NULL AND quality IS NOT NULL),
n AS (SELECT sum(toxic) AS t1, sum(1 - toxic) AS t0, sum(quality) AS q1, sum(1 - quality) AS q0 FROM t),
f AS (SELECT feature, sum(toxic) AS ta, sum(1 - toxic) AS tb, sum(quality) AS qa, sum(1 - quality) AS qb FROM tokens JOIN t ON tokens.cell_id = t.cell_id GROUP BY feature),
tw AS (SELECT feature, CAST(ta * t0 - tb * t1 AS DOUBLE) AS w FROM f, n ORDER BY abs(w) DESC, feature LIMIT 100),
qw AS (SELECT feature, CAST(qa * q0 - qb * q1 AS DOUBLE) AS w FROM f, n ORDER BY abs(w) DESC, feature LIMIT 100),
x AS (SELECT cell_id, sum(value * tw.w) AS ht, sum(value * qw.w) AS hq FROM tokens LEFT JOIN tw USING (feature) LEFT JOIN qw USING (feature) GROUP BY cell_id),
h AS (SELECT d.cell_id, d.batch, coalesce(ht, 0) AS ht, coalesce(hq, 0) AS hq FROM d LEFT JOIN x ON x.cell_id = d.cell_id),
th AS (SELECT h.*, toxic, quality FROM h JOIN t ON h.cell_id = t.cell_id),
c0 AS (SELECT batch, floor(avg(ht)) AS cut FROM th GROUP BY batch),
m0 AS (SELECT (coalesce(avg(ht) FILTER (toxic = 0), 0) + coalesce(avg(ht) FILTER (toxic = 1), 0)) / 2 AS mid FROM th),
p AS (SELECT th.*, CASE WHEN ht < cut THEN 'L' WHEN ht > cut THEN 'R' END AS side FROM th JOIN c0 USING (batch)),
c1 AS (SELECT batch, side, floor(avg(hq)) AS cut FROM p WHERE side IS NOT NULL GROUP BY ALL),
m1 AS (SELECT side, (coalesce(avg(hq) FILTER (quality = 0), 0) + coalesce(avg(hq) FILTER (quality = 1), 0)) / 2 AS mid FROM p WHERE side IS NOT NULL GROUP BY side),
s AS (SELECT h.*, c0.cut IS NOT NULL AS seen, CASE WHEN ht < coalesce(c0.cut, mid) THEN 'L' WHEN ht > coalesce(c0.cut, mid) THEN 'R' END AS side FROM h CROSS JOIN m0 LEFT JOIN c0 ON c0.batch = h.batch),
e AS (SELECT s.*, CASE WHEN seen THEN c1.cut ELSE m1.mid END AS cut FROM s LEFT JOIN c1 ON c1.batch = s.batch AND c1.side = s.side LEFT JOIN m1 ON m1.side = s.side)
SELECT batch, cell_id, coalesce(side, '') || CASE WHEN hq < cut THEN 'L' WHEN hq > cut THEN 'R' ELSE '' END AS path FROM e""")
def stream_projected_leaves(spark, sf):
    """Arriving documents scored by a tree that is stored and loaded again; its directions come from three languages, the fourth is new to it."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cell_id"), F.col("lang").alias("batch"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("cell_id"), "toxic", "quality").dropna()
    long = materialize(token_counts(spark, sf).select("cell_id", "feature", "value").join(documents, "cell_id"))
    rows, features = pack_expression(documents, long)
    training = materialize(documents.filter("batch <> 'es'").join(labels, "cell_id"))
    store, source, sink = scratch(spark, "label-tree"), scratch(spark, "packed-in"), scratch(spark, "packed-out")
    each = max(2, spark.sparkContext.defaultParallelism)  # files of a micro-batch, so that all cores have one
    rows.repartition(4 * each, F.xxhash64("cell_id")).write.parquet(source)  # in no order of ids or batches
    arriving = spark.read.parquet(source)
    tree = label_tree(training, long, features)
    TS.save_consensus(tree, TS.place_cells(arriving, tree), store, "labels")
    loaded, _ = TS.load_consensus(spark, store, "labels", features)
    stream = scorer.read_cells(spark, source, arriving.schema, each)
    scorer.run_to_table(scorer.score_stored(stream, loaded).select("batch", "cell_id", "path"), sink, scratch(spark, "packed-state"))
    return spark.read.parquet(sink)
