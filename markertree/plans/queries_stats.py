"""Queries over closed-form statistics, trees, features, neighbours and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from markertree.functions import stats as ST
from markertree.functions import tree_ids as TI
from markertree.operators import assign as A
from markertree.operators import evaluate as E
from markertree.operators import features as FE
from markertree.operators import moments as M
from markertree.operators import neighbors as NB
from markertree.operators import normalize as N
from markertree.operators import codes as CO
from markertree.operators import treetables as T
from markertree.operators.select import top_per_group
from markertree.plans.registry import LINE_SQL, LONG_SQL, TOKENS_SQL, query, r, rounded
from markertree.sources.tables import embedding_dims, line_cells, line_long, table, token_counts

LL1 = lambda v: f"(-0.5 * (ln(2 * pi()) + ln({v} + 1e-6) + {v} / ({v} + 1e-6)))"


# ---------------------------------------------------------------- mixtures, closed form

@query("single_gaussian_ll", "MIX-2 MIX-3", f"""
WITH {LONG_SQL}, m AS (SELECT batch, feature, count(*) AS n, var_pop(ln(value + 1)) AS v FROM long GROUP BY ALL)
SELECT batch, feature, n, round({LL1('v')}, 6) AS ll, round(-2 * n * {LL1('v')} + 2 * ln(n), 3) AS bic FROM m""")
def single_gaussian_ll(spark, sf):
    logged = N.log_transform(line_long(spark, sf))
    s = A.single_gaussian_scores(logged, ["batch", "feature"], ["value"])
    return rounded(rounded(s, "ll"), "bic", digits=3).select("batch", "feature", "n", "ll", "bic")


@query("pair_gaussian_ll", "MIX-2", f"""
WITH {LINE_SQL}, m AS (SELECT batch, count(*) AS n, var_pop(qty) + 1e-6 AS a, var_pop(disc) + 1e-6 AS b, covar_pop(qty, disc) AS c,
  var_pop(qty) AS va, var_pop(disc) AS vb FROM cells GROUP BY batch)
SELECT batch, n, round(-0.5 * (2 * ln(2 * pi()) + ln(a * b - c * c) + (b * va - 2 * c * c + a * vb) / (a * b - c * c)), 6) AS ll FROM m""")
def pair_gaussian_ll(spark, sf):
    s = A.single_gaussian_scores(line_cells(spark, sf), ["batch"], ["qty", "disc"])
    return s.select("batch", "n", r("ll").alias("ll"))


MONTHS_SQL = """m AS (SELECT month(o_orderdate) AS comp, count(*) AS n, avg(o_totalprice) AS mu, var_pop(o_totalprice) AS v FROM orders GROUP BY ALL)"""


def month_components(spark, sf):
    return table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("comp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mu"), F.var_pop("o_totalprice").alias("v"))


@query("component_overlap_pairs", "MIX-5 JOI-8 UDF-1", f"""
WITH {MONTHS_SQL} SELECT a.comp AS c1, b.comp AS c2, round(exp(-((a.mu - b.mu) ** 2 / ((a.v + b.v) / 2) / 8
   + 0.5 * ln((a.v + b.v) / 2) - 0.25 * ln(a.v) - 0.25 * ln(b.v))), 6) AS similarity FROM m a JOIN m b ON a.comp < b.comp""")
def component_overlap_pairs(spark, sf):
    m = month_components(spark, sf)
    a, b = m.select(*[F.col(c).alias(f"{c}1") for c in m.columns]), m.select(*[F.col(c).alias(f"{c}2") for c in m.columns])
    pairs = a.join(b, F.col("comp1") < F.col("comp2"))
    return pairs.select(F.col("comp1").alias("c1"), F.col("comp2").alias("c2"),
                        r(F.exp(-ST.bhattacharyya("mu1", "v1", "mu2", "v2"))).alias("similarity"))


@query("pair_component_overlap", "MIX-5 UDF-1", f"""
WITH {LINE_SQL}, m AS (SELECT batch, avg(qty) mx, avg(price) my, var_samp(qty) a, var_samp(price) b, covar_samp(qty, price) c FROM cells GROUP BY batch),
p AS (SELECT x.batch AS b1, y.batch AS b2, x.mx - y.mx AS dx, x.my - y.my AS dy, (x.a + y.a) / 2 AS a, (x.b + y.b) / 2 AS b, (x.c + y.c) / 2 AS c,
  x.a * x.b - x.c ** 2 AS d1, y.a * y.b - y.c ** 2 AS d2 FROM m x JOIN m y ON x.batch < y.batch)
SELECT b1, b2, round(exp(-((b * dx * dx - 2 * c * dx * dy + a * dy * dy) / (a * b - c * c) / 8 + 0.5 * ln(a * b - c * c) - 0.25 * ln(d1) - 0.25 * ln(d2))), 6) AS similarity FROM p""")
def pair_component_overlap(spark, sf):
    m = M.moments(line_cells(spark, sf), ["batch"], ["qty", "price"])
    x, y = (m.select(*[F.col(c).alias(f"{s}_{c}") for c in m.columns]) for s in "xy")
    side = lambda s: ((f"{s}_mean_qty", f"{s}_mean_price"), (f"{s}_var_qty", f"{s}_var_price", f"{s}_cov_qty_price"))
    (m1, c1), (m2, c2) = side("x"), side("y")
    return x.join(y, F.col("x_batch") < F.col("y_batch")).select(
        F.col("x_batch").alias("b1"), F.col("y_batch").alias("b2"),
        r(F.exp(-ST.bhattacharyya_2d(m1, c1, m2, c2))).alias("similarity"))


POST_SQL = f"""{LINE_SQL}, s AS (SELECT *, CASE WHEN disc > 0.05 THEN 'R' ELSE 'L' END AS side FROM cells),
m AS (SELECT batch, count(*) FILTER (side = 'L') / count(*) AS w, avg(price) FILTER (side = 'L') ml, avg(price) FILTER (side = 'R') mr,
  var_samp(price) FILTER (side = 'L') vl, var_samp(price) FILTER (side = 'R') vr FROM s GROUP BY batch),
d AS (SELECT s.batch, cell_id, side, w * exp(-0.5 * (ln(vl) + (price - ml) ** 2 / vl)) AS l, (1 - w) * exp(-0.5 * (ln(vr) + (price - mr) ** 2 / vr)) AS r FROM s JOIN m USING (batch))"""


@query("side_posteriors", "MIX-16 MIX-13 MIX-8", f"""
WITH {POST_SQL} SELECT cell_id, side, round(CASE WHEN side = 'L' THEN l / (l + r) ELSE r / (l + r) END, 6) AS posterior FROM d""")
def side_posteriors(spark, sf):
    cells = line_cells(spark, sf).withColumn("side", F.when(F.col("disc") > 0.05, "R").otherwise("L"))
    return A.side_posterior(cells, "side", ["price"], ["batch"]).select("cell_id", "side", r("posterior").alias("posterior"))


@query("chained_path_posteriors", "MIX-15", f"""
WITH {POST_SQL}, one AS (SELECT cell_id, side, CASE WHEN side = 'L' THEN l / (l + r) ELSE r / (l + r) END AS p FROM d),
c AS (SELECT cells.batch, cells.cell_id, qty, one.side AS node, p, CASE WHEN tax > 0.04 THEN 'R' ELSE 'L' END AS s2 FROM cells JOIN one USING (cell_id)),
m2 AS (SELECT batch, node, count(*) FILTER (s2 = 'L') / count(*) AS w, avg(qty) FILTER (s2 = 'L') ml, avg(qty) FILTER (s2 = 'R') mr,
  var_samp(qty) FILTER (s2 = 'L') vl, var_samp(qty) FILTER (s2 = 'R') vr FROM c GROUP BY batch, node),
e AS (SELECT cell_id, s2, p, w * exp(-0.5 * (ln(vl) + (qty - ml) ** 2 / vl)) AS l, (1 - w) * exp(-0.5 * (ln(vr) + (qty - mr) ** 2 / vr)) AS r FROM c JOIN m2 USING (batch, node))
SELECT cell_id, s2, round(p * CASE WHEN s2 = 'L' THEN l / (l + r) ELSE r / (l + r) END, 6) AS path_posterior FROM e""")
def chained_path_posteriors(spark, sf):
    cells = line_cells(spark, sf).withColumn("node", F.when(F.col("disc") > 0.05, "R").otherwise("L"))
    first = A.side_posterior(cells, "node", ["price"], ["batch"]).withColumnRenamed("posterior", "p")
    second = first.withColumn("s2", F.when(F.col("tax") > 0.04, "R").otherwise("L"))
    out = A.side_posterior(second, "s2", ["qty"], ["batch", "node"], chain="p")
    return out.select("cell_id", "s2", r("path_posterior").alias("path_posterior"))


@query("confident_cells", "MIX-15 SPL-7", f"""
WITH {POST_SQL}, o AS (SELECT cell_id, side, CASE WHEN side = 'L' THEN l / (l + r) ELSE r / (l + r) END AS p FROM d)
SELECT cell_id, side FROM o WHERE p > 0.5""")
def confident_cells(spark, sf):
    cells = line_cells(spark, sf).withColumn("side", F.when(F.col("disc") > 0.05, "R").otherwise("L"))
    return A.side_posterior(cells, "side", ["price"], ["batch"], keep_above=0.5).select("cell_id", "side")


@query("assign_to_leaf_gaussians", "MIX-14 MIX-7", f"""
WITH {LINE_SQL}, t AS (SELECT *, concat(batch, CAST(qty > 25 AS INTEGER)) AS leaf FROM cells),
m AS (SELECT leaf, count(*) / (SELECT count(*) FROM t) AS w, avg(qty) mx, avg(price) my, var_samp(qty) a, var_samp(price) b, covar_samp(qty, price) c FROM t GROUP BY leaf),
s AS (SELECT cell_id, m.leaf AS leaf_label, ln(w) - ln(2 * pi()) - 0.5 * ln(a * b - c * c) - 0.5 * (b * (qty - mx) ** 2 - 2 * c * (qty - mx) * (price - my) + a * (price - my) ** 2) / (a * b - c * c) AS v FROM t CROSS JOIN m),
k AS (SELECT cell_id, leaf_label, exp(v) / sum(exp(v)) OVER (PARTITION BY cell_id) AS p, row_number() OVER (PARTITION BY cell_id ORDER BY v DESC) AS k FROM s)
SELECT cell_id, CASE WHEN p > 0.9 / 6 * 2 THEN leaf_label END AS leaf_label, round(p, 6) AS p FROM k WHERE k = 1""")
def assign_to_leaf_gaussians(spark, sf):
    cells = line_cells(spark, sf).withColumn("leaf", F.concat("batch", (F.col("qty") > 25).cast("int").cast("string")))
    leaves = A.leaf_gaussians(cells, "leaf", ["qty", "price"])
    return A.assign_to_leaves(cells, leaves, ["qty", "price"], confidence=0.9).select(
        "cell_id", "leaf_label", r("leaf_probability").alias("p"))


@query("weighted_crossing_cutoffs", "MIX-17", f"""
WITH {LONG_SQL}, g AS (SELECT feature, CASE WHEN batch = 'A' THEN 0 ELSE 1 END AS comp, value FROM long),
m AS (SELECT feature, avg(ln(value + 1)) FILTER (comp = 0) AS m1, avg(ln(value + 1)) FILTER (comp = 1) + 1 AS m2,
  var_pop(ln(value + 1)) FILTER (comp = 0) AS v1, var_pop(ln(value + 1)) FILTER (comp = 1) AS v2,
  count(*) FILTER (comp = 0) / count(*) AS w1, count(*) FILTER (comp = 1) / count(*) AS w2 FROM g GROUP BY feature),
q AS (SELECT *, 1 / (2 * v1) - 1 / (2 * v2) AS a, m2 / v2 - m1 / v1 AS b,
  m1 ** 2 / (2 * v1) - m2 ** 2 / (2 * v2) - ln(sqrt(v2) * w1 / (sqrt(v1) * w2)) AS c FROM m),
x AS (SELECT feature, least(m1, m2) AS lo, greatest(m1, m2) AS hi, (-b + sqrt(b * b - 4 * a * c)) / (2 * a) AS r1, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS r2 FROM q)
SELECT feature, round(CASE WHEN r1 > lo AND r1 < hi THEN r1 WHEN r2 > lo AND r2 < hi THEN r2 END, 4) AS cutoff FROM x""")
def weighted_crossing_cutoffs(spark, sf):
    logged = N.log_transform(line_long(spark, sf)).withColumn("comp", F.when(F.col("batch") == "A", 0).otherwise(1))
    m = logged.groupBy("feature", "comp").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("value") + F.max("comp")).alias("mean"), F.var_pop("value").alias("var"))
    total = m.groupBy("feature").agg(F.sum("n").alias("t"))
    components = m.join(total, "feature").withColumn("weight", F.col("n") / F.col("t"))
    return rounded(T.marker_cutoffs(components), "cutoff", digits=4)


@query("merged_mixture_labels", "MIX-7 MIX-8", f"""
WITH {LINE_SQL}, m AS (SELECT least(floor(price / 26000), 3) AS c, count(*) / (SELECT count(*) FROM cells) AS w, avg(price) AS mu, var_pop(price) AS v FROM cells GROUP BY ALL),
d AS (SELECT cell_id, c, w * exp(-0.5 * (ln(v) + (price - mu) ** 2 / v)) AS d FROM cells CROSS JOIN m),
s AS (SELECT cell_id, CASE WHEN c < 2 THEN 0 WHEN c = 2 THEN 1 ELSE 2 END AS label, sum(d) AS d FROM d GROUP BY ALL)
SELECT cell_id, first(label ORDER BY d DESC, label) AS label FROM s GROUP BY cell_id""")
def merged_mixture_labels(spark, sf):
    cells = line_cells(spark, sf)
    rows = cells.groupBy(F.least(F.floor(F.col("price") / 26000), F.lit(3)).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mu"), F.var_pop("price").alias("v")).orderBy("c").collect()
    total = sum(x["n"] for x in rows)
    comps = [(x["n"] / total, x["mu"], x["v"]) for x in rows]
    return cells.select("cell_id", A.merged_label("price", comps, [0, 0, 1, 2]).alias("label"))


@query("projection_overlap", "MIX-21 MIX-22", f"""
WITH {LINE_SQL}, s AS (SELECT price AS h, qty > 25 AS side FROM cells),
m AS (SELECT count(*) AS n, avg(h) FILTER (NOT side) AS m0, avg(h) FILTER (side) AS m1, var_samp(h) FILTER (NOT side) AS v0, var_samp(h) FILTER (side) AS v1 FROM s),
o AS (SELECT *, exp(-((m0 - m1) ** 2 / ((v0 + v1) / 2) / 8 + 0.5 * ln((v0 + v1) / 2) - 0.25 * ln(v0) - 0.25 * ln(v1))) AS overlap,
  CASE WHEN n > 10000 THEN 0.02 ELSE 0.05 * (2 - n / 10000) END AS bar FROM m)
SELECT n, round(m0, 4) AS m0, round(m1, 4) AS m1, round(overlap, 6) AS overlap, round(bar, 6) AS bar,
  round(v0 / m0 ** 2 + v1 / m1 ** 2, 6) AS within, round((m1 - m0) ** 2 / ((m0 ** 2 + m1 ** 2) / 2), 6) AS between, overlap < bar AS separable FROM o""")
def projection_overlap(spark, sf):
    h = line_cells(spark, sf).select(F.col("price").alias("h"), F.when(F.col("qty") > 25, "R").otherwise("L").alias("side"))
    out = A.projection_overlap(h, "side")
    return rounded(rounded(out, "overlap", "bar", "within", "between"), "m0", "m1", digits=4)


@query("entropy_scores", "MIX-12", f"""
WITH {LINE_SQL}, p AS (SELECT batch, count(*) / (SELECT count(*) FROM cells) AS p FROM cells GROUP BY batch)
SELECT batch, round(-p * log2(p) - (1 - p) * log2(1 - p), 6) AS entropy FROM p""")
def entropy_scores(spark, sf):
    s = M.leaf_summary(line_cells(spark, sf), "batch", ["qty"])
    return s.select("batch", r(ST.binary_entropy("proportion")).alias("entropy"))


@query("two_cut_sides", "XDS-12", f"""
WITH {LINE_SQL}, h AS (SELECT cell_id, disc * 100 + tax * 100 AS h FROM cells)
SELECT cell_id, CASE WHEN h < 9 - 5 * 0.9 * 0.01 THEN 'L' WHEN h > 9 + 5 * 0.9 * 0.01 THEN 'R' END AS side FROM h""")
def two_cut_sides(spark, sf):
    h = line_cells(spark, sf).select("cell_id", (F.col("disc") * 100 + F.col("tax") * 100).alias("h"))
    return A.two_cut_sides(h, 4.0, 14.0, 0.1).select("cell_id", "side")


# ---------------------------------------------------------------- log-likelihood gain (flagship)

@query("best_marker_by_ll_gain", "NRM-1 SPL-2 SPL-5 WIN-1", f"""
WITH {LONG_SQL}, clr AS (SELECT batch, cell_id, feature, ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY batch, feature) AS v FROM long),
s AS (SELECT batch, feature, v, v > 0 AS hi FROM clr),
m AS (SELECT batch, feature, count(*) AS n, count(*) FILTER (hi) AS n1, count(*) FILTER (NOT hi) AS n0, var_pop(v) AS va,
  var_pop(v) FILTER (hi) AS v1, var_pop(v) FILTER (NOT hi) AS v0 FROM s GROUP BY ALL),
g AS (SELECT batch, feature, n0, n1, CASE WHEN n0 < 100 OR n1 < 100 THEN -1000 ELSE {LL1('v1')} * n1 / n + {LL1('v0')} * n0 / n - {LL1('va')} END AS gain FROM m)
SELECT batch, feature, n0, n1, round(gain, 6) + 0.0 AS gain, row_number() OVER (PARTITION BY batch ORDER BY gain DESC, feature) AS rank FROM g""")
def best_marker_by_ll_gain(spark, sf):
    from markertree.plans.gain import marker_gains

    return rounded(marker_gains(line_long(spark, sf)), "gain")


# ---------------------------------------------------------------- tree tables

NODE_SQL = """nodes AS (SELECT DISTINCT CAST(o_custkey % 63 AS BIGINT) AS node_id FROM orders)"""


def order_nodes(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 63).cast("bigint").alias("node_id")).distinct()


@query("breadth_and_depth_first", "TRE-1 TRE-2 TRE-3 TRE-12", f"""
WITH RECURSIVE {NODE_SQL}, w AS (SELECT CAST(0 AS BIGINT) AS node_id, '' AS path UNION ALL
  SELECT 2 * node_id + u.s, path || CASE u.s WHEN 1 THEN 'L' ELSE 'R' END FROM w, (VALUES (1), (2)) u(s) WHERE length(path) < 6)
SELECT node_id, path, row_number() OVER (ORDER BY length(path), node_id) - 1 AS bfs, row_number() OVER (ORDER BY path) - 1 AS dfs FROM nodes JOIN w USING (node_id)""")
def breadth_and_depth_first(spark, sf):
    nodes = order_nodes(spark, sf)
    both = T.depth_first(T.breadth_first(nodes))
    return both.select("node_id", TI.node_to_path("node_id").alias("path"), F.col("bfs").cast("bigint").alias("bfs"),
                       F.col("dfs").cast("bigint").alias("dfs"))


@query("id_arithmetic", "UDF-1 TRE-6 FLT-5", """
SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 2 END AS parent, CAST(floor(log2(o_orderkey + 1)) AS INTEGER) AS depth,
  log2(o_orderkey + 1) >= 2 AND ((o_orderkey + 1) >> greatest(CAST(floor(log2(o_orderkey + 1)) AS INTEGER) - 2, 0)) = 6 AS under_5 FROM orders""")
def id_arithmetic(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", TI.node_parent("o_orderkey").alias("parent"), TI.node_depth("o_orderkey").alias("depth"),
                    TI.is_ancestor(F.lit(5), F.col("o_orderkey")).alias("under_5"))


@query("leaf_labels_of_cells", "TRE-4 XDS-21", f"""
WITH {LINE_SQL}, a AS (SELECT cell_id, CASE WHEN qty <= 25 THEN 1 WHEN tax <= 0.04 THEN 5 ELSE 6 END AS node FROM cells)
SELECT cell_id, concat(CASE node WHEN 1 THEN 1 WHEN 5 THEN 3 ELSE 4 END, '_leaf') AS label FROM a""")
def leaf_labels_of_cells(spark, sf):
    cells = line_cells(spark, sf)
    at = lambda cond, node: cells.filter(cond).select("cell_id", F.lit(node).cast("bigint").alias("node_id"))
    assigned = at("true", 0).union(at("qty <= 25", 1)).union(at("qty > 25", 2)).union(at("qty > 25 and tax <= 0.04", 5)).union(at("qty > 25 and tax > 0.04", 6))
    nodes = assigned.select("node_id").distinct()
    return T.leaf_labels(assigned, nodes)


@query("labels_at_chosen_nodes", "TRE-4", f"""
WITH {LINE_SQL} SELECT cell_id, CASE WHEN qty > 25 AND tax > 0.04 THEN 'taxed' ELSE 'all' END AS label FROM cells""")
def labels_at_chosen_nodes(spark, sf):
    """Labels at a cut of the tree: the deepest of the named nodes that a cell reached."""
    cells = line_cells(spark, sf)
    reached = cells.select("cell_id", F.explode(F.filter(F.array(
        F.lit(0), F.when(F.col("qty") > 25, 2).otherwise(1), F.when((F.col("qty") > 25) & (F.col("tax") > 0.04), 6)),
        lambda n: n.isNotNull()).cast("array<bigint>")).alias("node_id"))
    return T.labels_at(reached, spark.createDataFrame([(0, "all"), (6, "taxed")], "node_id bigint, name string"))


@query("membership_matrix", "TRE-5", f"""
WITH {LINE_SQL} SELECT cell_id, 1 AS "0", CAST(qty <= 25 AS INTEGER) AS "1", CAST(qty > 25 AS INTEGER) AS "2" FROM cells""")
def membership_matrix(spark, sf):
    cells = line_cells(spark, sf)
    long = cells.select("cell_id", F.explode(F.array(F.lit(0), F.when(F.col("qty") <= 25, 1).otherwise(2))).alias("node_id"))
    return T.membership_matrix(long, [0, 1, 2])


@query("prune_tree", "TRE-7", f"""
WITH {NODE_SQL}, a AS (SELECT node_id, CAST(((node_id + 1) >> CAST(d AS INTEGER)) - 1 AS BIGINT) AS up FROM nodes, range(6) t(d) WHERE ((node_id + 1) >> CAST(d AS INTEGER)) > 0),
c AS (SELECT node_id, min(up) AS cut FROM a WHERE up IN (4, 6, 13) GROUP BY node_id)
SELECT node_id, CASE WHEN cut = node_id THEN 'cutleaf' ELSE 'node' END AS status FROM nodes LEFT JOIN c USING (node_id) WHERE cut IS NULL OR cut = node_id""")
def prune_tree(spark, sf):
    nodes = order_nodes(spark, sf).withColumn("status", F.lit("node"))
    cut = spark.createDataFrame([(4,), (6,), (13,)], "node_id bigint")
    return T.prune(nodes, cut)


@query("splice_out_subtree", "TRE-8 TRE-9", f"""
WITH {NODE_SQL}, RECURSIVE_FREE AS (SELECT node_id, CAST(floor(log2(node_id + 1)) AS INTEGER) AS d FROM nodes)
SELECT node_id, CAST(CASE WHEN d >= 1 AND ((node_id + 1) >> (d - 1)) = 3 AND d >= 2 AND ((node_id + 1) >> (d - 2)) = 7
  THEN node_id + 1 - (7 << (d - 2)) + (3 << (d - 2)) - 1 ELSE node_id END AS BIGINT) AS new_id FROM RECURSIVE_FREE
WHERE NOT (node_id = 2 OR (d >= 2 AND ((node_id + 1) >> (d - 2)) = 6))""")
def splice_out_subtree(spark, sf):
    return T.splice_out(spark, order_nodes(spark, sf), [5]).select("node_id", "new_id")


@query("tree_level_counts", "UDF-4 TRE-1", f"""
WITH {NODE_SQL}, l AS (SELECT node_id, CAST(floor(log2(node_id + 1)) AS INTEGER) AS depth, node_id NOT IN (SELECT CAST((node_id - 1) // 2 AS BIGINT) FROM nodes WHERE node_id > 0) AS leaf FROM nodes)
SELECT depth, count(*) AS n_nodes, count(*) FILTER (leaf) AS n_leaves FROM l GROUP BY depth""")
def tree_level_counts(spark, sf):
    return T.tree_levels(order_nodes(spark, sf))


LEAF_LL_SQL = f"""{LINE_SQL}, l AS (SELECT concat(batch, CAST(qty > 25 AS INTEGER)) AS leaf, count(*) AS n, var_pop(price) AS v FROM cells GROUP BY ALL),
leaves AS (SELECT leaf, n, n / (SELECT sum(n) FROM l) * {LL1('v')} AS ll FROM l)"""


def leaf_lls(spark, sf):
    cells = line_cells(spark, sf).withColumn("leaf", F.concat("batch", (F.col("qty") > 25).cast("int").cast("string")))
    s = A.single_gaussian_scores(cells, ["leaf"], ["price"])
    from markertree.session import attach_row

    return attach_row(s, s.agg(F.sum("n").alias("t"))).select("leaf", "n", (F.col("n") / F.col("t") * F.col("ll")).alias("ll"))


@query("tree_log_likelihood_and_bic", "AGG-6 AGG-7", f"""
WITH {LEAF_LL_SQL} SELECT round(sum(ll), 6) AS ll, count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
  round(-2 * sum(ll) * sum(n) + (count(*) - 1 + count(*) + count(*)) * ln(sum(n)), 2) AS bic FROM leaves""")
def tree_log_likelihood_and_bic(spark, sf):
    return rounded(rounded(T.tree_scores(leaf_lls(spark, sf), 1), "ll"), "bic", digits=2)


@query("best_leaf_set_by_bic", "AGG-8", f"""
WITH {LEAF_LL_SQL}, steps AS (SELECT 1 AS step, leaf, n, ll FROM leaves UNION ALL SELECT 2, leaf, n, ll FROM leaves UNION ALL SELECT 2, leaf || 'x', n, ll FROM leaves WHERE leaf LIKE 'A%'),
s AS (SELECT step, sum(ll) AS ll, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM steps GROUP BY step),
b AS (SELECT step, ll, k, n, -2 * ll * n + (k - 1 + k + k) * ln(n) AS bic FROM s)
SELECT step, round(ll, 6) AS ll, k, n, round(bic, 2) AS bic FROM b ORDER BY bic LIMIT 1""")
def best_leaf_set_by_bic(spark, sf):
    leaves = leaf_lls(spark, sf)
    again = leaves.filter("leaf like 'A%'").withColumn("leaf", F.concat("leaf", F.lit("x")))
    steps = leaves.withColumn("step", F.lit(1)).unionByName(leaves.withColumn("step", F.lit(2))).unionByName(again.withColumn("step", F.lit(2)))
    return rounded(rounded(T.best_cut_by_bic(steps, 1), "ll"), "bic", digits=2)


CODES_SQL = f"""{LONG_SQL}, cut AS (SELECT feature, avg(value) AS cutoff FROM long GROUP BY feature),
q AS (SELECT cell_id, CAST(qty > 25 AS INTEGER)::VARCHAR || CAST(disc > 0.05 AS INTEGER)::VARCHAR || CAST(tax > 0.04 AS INTEGER)::VARCHAR AS leaf FROM cells),
lm AS (SELECT leaf, feature, count(*) AS n, avg(value) AS mean FROM long JOIN q USING (cell_id) GROUP BY ALL),
codes AS (SELECT leaf, max(n) AS n, string_agg(CASE WHEN mean > cutoff THEN '1' ELSE '0' END, '' ORDER BY feature) AS code FROM lm JOIN cut USING (feature) GROUP BY leaf)"""


def eight_leaf_codes(spark, sf):
    bit = lambda c: F.expr(f"cast(cast({c} as int) as string)")
    leaves = line_cells(spark, sf).select("cell_id", F.concat(bit("qty > 25"), bit("disc > 0.05"), bit("tax > 0.04")).alias("leaf"))
    long = line_long(spark, sf)
    cut = long.groupBy("feature").agg(F.avg("value").alias("cutoff"))
    means = long.join(leaves, "cell_id").groupBy("leaf", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return leaves, T.leaf_codes(means, cut)


@query("leaf_binary_codes", "TRE-13", f"WITH {CODES_SQL} SELECT leaf, n, code FROM codes")
def leaf_binary_codes(spark, sf):
    return eight_leaf_codes(spark, sf)[1]


@query("doublet_code_pairs", "JOI-11", f"""
WITH {CODES_SQL}, v AS (SELECT leaf, CAST(substr(code, 1, 1) AS INTEGER) * 8 + CAST(substr(code, 2, 1) AS INTEGER) * 4 + CAST(substr(code, 3, 1) AS INTEGER) * 2 + CAST(substr(code, 4, 1) AS INTEGER) AS v FROM codes)
SELECT a.leaf AS a, b.leaf AS b, c.leaf AS c FROM v a JOIN v b ON a.leaf < b.leaf JOIN v c ON c.v = (a.v | b.v) WHERE c.leaf NOT IN (a.leaf, b.leaf)""")
def doublet_code_pairs(spark, sf):
    return CO.or_groups(eight_leaf_codes(spark, sf)[1], 2)


VALUES_SQL = f"""{CODES_SQL}, v AS (SELECT leaf, n, code, list_sum(list_transform(string_split(code, ''), lambda c, i: CAST(c AS BIGINT) << (length(code) - i))) AS v FROM codes)"""


@query("doublet_code_triples", "JOI-11", f"""
WITH {VALUES_SQL}
SELECT a.leaf AS a, b.leaf AS b, d.leaf AS d, c.leaf AS c FROM v a JOIN v b ON a.leaf < b.leaf JOIN v d ON b.leaf < d.leaf
JOIN v c ON CAST(c.v AS BIGINT) = (CAST(a.v AS BIGINT) | CAST(b.v AS BIGINT) | CAST(d.v AS BIGINT)) WHERE c.leaf NOT IN (a.leaf, b.leaf, d.leaf)""")
def doublet_code_triples(spark, sf):
    return CO.or_groups(eight_leaf_codes(spark, sf)[1], 3)


TYPES_SQL = f"""
WITH RECURSIVE {VALUES_SQL}, o AS MATERIALIZED (
  SELECT leaf, n, code, CAST(v AS BIGINT) AS v, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, leaf) AS i FROM v),
step AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(v BIGINT, s DOUBLE)[]) AS basis, CAST([] AS DOUBLE[]) AS pairs, CAST([] AS DOUBLE[]) AS triples
  UNION ALL
  SELECT i, CASE WHEN len(pairs) + len(triples) = 0 THEN list_append(basis, {{'v': t, 's': share}}) ELSE basis END, pairs, triples FROM (
    SELECT i, basis, t, share, pairs, CASE WHEN len(pairs) > 0 THEN [] ELSE flatten(flatten(list_transform(basis, lambda a, p: list_transform(basis, lambda b, q:
      list_transform(list_filter(basis, lambda d, r: p < q AND q < r AND (a.v | b.v | d.v) = t), lambda d: a.s * b.s * d.s))))) END AS triples FROM (
      SELECT o.i, basis, o.v AS t, o.share, flatten(list_transform(basis, lambda a, p: list_transform(
        list_filter(basis, lambda b, q: p <= q AND (a.v | b.v) = o.v), lambda b: a.s * b.s))) AS pairs
      FROM step JOIN o ON o.i = step.i + 1))),
types AS (SELECT o.*, len(pairs) + len(triples) AS groups, coalesce(list_max(list_concat(pairs, triples)), 0) AS top FROM o JOIN step USING (i))"""


@query("basis_and_artificial_types", "TRE-14 AGG-14", TYPES_SQL + """
SELECT leaf, n, code, CAST(groups = 0 AS INTEGER) AS basis, CAST(groups AS BIGINT) AS groups, round(top / share, 6) + 0.0 AS merge_constant FROM types""")
def basis_and_artificial_types(spark, sf):
    return rounded(CO.leaf_types(eight_leaf_codes(spark, sf)[1]), "merge_constant")


@query("multiplet_share", "AGG-15", f"""
WITH {LINE_SQL} SELECT round(avg(CASE WHEN qty > 25 AND tax > 0.04 THEN 1 ELSE 0 END), 9) AS multiplet_ratio FROM cells""")
def multiplet_share(spark, sf):
    """Share of cells in artificial leaf types, the types given by their codes."""
    leaves, _ = eight_leaf_codes(spark, sf)
    types = leaves.select("leaf").distinct().withColumn(
        "basis", F.when((F.substring("leaf", 1, 1) == "1") & (F.substring("leaf", 3, 1) == "1"), 0).otherwise(1))
    return rounded(T.multiplet_ratio(T.flag_multiplets(leaves, types)), "multiplet_ratio", digits=9)


@query("multiplet_cells", "TRE-15", TYPES_SQL + """
SELECT cell_id, leaf, CAST(groups > 0 AS INTEGER) AS multiplet FROM q JOIN types USING (leaf)""")
def multiplet_cells(spark, sf):
    leaves, codes = eight_leaf_codes(spark, sf)
    return T.flag_multiplets(leaves, CO.leaf_types(codes)).select("cell_id", "leaf", "multiplet")


# ---------------------------------------------------------------- differential features

WELCH_SQL = f"""{TOKENS_SQL}, g AS (SELECT CAST(doc_id AS VARCHAR) AS cell_id, lang AS "group" FROM documents),
gs AS (SELECT "group", count(*) AS n, (SELECT count(*) FROM g) AS n_all FROM g GROUP BY "group"),
tg AS (SELECT feature, "group", sum(ln(1 + value)) AS s, sum(ln(1 + value) ** 2) AS ss FROM tokens JOIN g USING (cell_id) GROUP BY ALL),
fa AS (SELECT feature, sum(s) AS sa, sum(ss) AS ssa FROM tg GROUP BY feature),
fu AS (SELECT fa.feature, gs."group", n, n_all - n AS n0, sa, ssa, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss FROM fa CROSS JOIN gs LEFT JOIN tg ON tg.feature = fa.feature AND tg."group" = gs."group"),
w AS (SELECT feature, "group", s / n AS m1, (sa - s) / n0 AS m0, greatest((ss - s * s / n) / (n - 1), 0) AS v1,
  greatest((ssa - ss - (sa - s) * (sa - s) / n0) / (n0 - 1), 0) AS v0, n, n0 FROM fu),
scores AS (SELECT "group", feature, m1, m0, CASE WHEN v1 / n + v0 / n0 > 0 THEN (m1 - m0) / sqrt(v1 / n + v0 / n0) ELSE 0 END AS score FROM w)"""


def language_groups(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cell_id"), F.col("lang").alias("group"))


@query("welch_feature_ranking", "DIF-1 WIN-2", f"""
WITH {WELCH_SQL} SELECT "group", feature, round(m1, 6) AS mean_in, round(m0, 6) AS mean_out, round(score, 4) + 0.0 AS score FROM scores""")
def welch_feature_ranking(spark, sf):
    logged = N.log_transform(token_counts(spark, sf))
    s = FE.welch_scores(logged, language_groups(spark, sf))
    return rounded(rounded(s, "mean_in", "mean_out"), "score", digits=4)


@query("split_feature_set", "DIF-2", f"""
WITH {WELCH_SQL}, k AS (SELECT feature, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 4) + 0.0 DESC, feature) AS k FROM scores)
SELECT DISTINCT feature FROM k WHERE k <= 200""")
def split_feature_set(spark, sf):
    logged = N.log_transform(token_counts(spark, sf))
    s = rounded(FE.welch_scores(logged, language_groups(spark, sf)), "score", digits=4)
    return FE.split_feature_set(s, 1000)


@query("common_split_features", "DIF-3", f"""
WITH {TOKENS_SQL}, s AS (SELECT batch, feature, sum(value) AS v FROM tokens GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY v DESC, feature) AS k FROM s),
c AS (SELECT feature FROM s GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT batch) FROM s))
SELECT DISTINCT feature FROM k WHERE k <= 30 AND feature IN (SELECT feature FROM c)""")
def common_split_features(spark, sf):
    tokens = token_counts(spark, sf)
    s = tokens.groupBy("batch", "feature").agg(F.sum("value").alias("v"))
    sets = top_per_group(s, ["batch"], [F.desc("v"), F.asc("feature")], 30)
    return FE.common_split_features(tokens, sets)


@query("variable_features", "DIF-5", f"""
WITH {TOKENS_SQL}, n AS (SELECT source AS batch, count(*) AS n FROM documents GROUP BY ALL),
m AS (SELECT batch, feature, sum(value) / any_value(n) AS mean, (sum(value * value) - sum(value) ** 2 / any_value(n)) / (any_value(n) - 1) AS v FROM tokens JOIN n USING (batch) GROUP BY ALL),
l AS (SELECT batch, feature, mean, ln(1 + mean) AS lm, ln(v / mean) AS ld FROM m WHERE v > 0),
b AS (SELECT *, CASE WHEN max(lm) OVER p > min(lm) OVER p THEN least(floor((lm - min(lm) OVER p) / ((max(lm) OVER p - min(lm) OVER p) / 20)), 19) ELSE 0 END AS bin FROM l WINDOW p AS (PARTITION BY batch)),
d AS (SELECT batch, feature, round(coalesce((ld - avg(ld) OVER q) / nullif(stddev_samp(ld) OVER q, 0), 1), 6) + 0.0 AS dispersion FROM b WINDOW q AS (PARTITION BY batch, bin))
SELECT batch, feature, dispersion FROM d WHERE dispersion > 0.5""")
def variable_features(spark, sf):
    logged = N.log_transform(token_counts(spark, sf))
    cells = table(spark, sf, "documents").select(F.col("source").alias("batch"))
    hv = FE.variable_features(logged, cells, ["batch"], min_disp=-1e9)
    return rounded(hv, "dispersion").filter("dispersion > 0.5").select("batch", "feature", "dispersion")


# ---------------------------------------------------------------- neighbours

@query("exact_nearest_neighbours", "KNN-1", """
WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, list_distance(a.v, b.v) AS dist FROM e a CROSS JOIN e b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d)
SELECT query_id, ref_id, round(dist, 6) AS dist, rank FROM k WHERE rank <= 10""")
def exact_nearest_neighbours(spark, sf):
    e = embedding_dims(spark, sf)
    return rounded(NB.nearest_neighbors(e, e, 10), "dist")


@query("weighted_neighbour_vote", "KNN-2 KNN-4", """
WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.label, b.vec_id AS ref_id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d),
v AS (SELECT query_id, label, count(*) FILTER (dist = 0) AS exact, sum(CASE WHEN dist > 0 THEN 1 / dist ELSE 0 END) AS w FROM k WHERE rank <= 10 GROUP BY ALL),
b AS (SELECT query_id, first(label ORDER BY exact DESC, CASE WHEN exact > 0 THEN 0 ELSE w END DESC, label) AS label FROM v GROUP BY query_id)
SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN b.label ELSE e.label END AS label FROM e LEFT JOIN b ON vec_id = query_id""")
def weighted_neighbour_vote(spark, sf):
    e = embedding_dims(spark, sf).withColumn("label", F.when(F.col("vec_id") % 4 != 0, F.col("label")))
    return NB.fill_unassigned(e, 10, "vec_id", "x", "label").select("vec_id", "label")


@query("confident_core_relabel", "KNN-3")
def confident_core_relabel(spark, sf):
    e = embedding_dims(spark, sf).select(
        "vec_id", F.element_at("x", 1).alias("m"), F.slice("x", 2, 4).alias("pcs"),
        F.when(F.element_at("x", 1) > 0, "R").otherwise("L").alias("side"))
    out = NB.relabel_from_core(e, "vec_id", "side", "m", "pcs", bar=0.6, min_seeds=(5, 3), min_side=5)
    return (e if out is None else out).select("vec_id", "side")


HALF_SQL = """e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
da AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v[1:32], b.v[1:32]) AS dist FROM e a CROSS JOIN e b),
db AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v[33:64], b.v[33:64]) AS dist FROM e a CROSS JOIN e b),
ga AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k FROM da) WHERE k <= 10),
gb AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k FROM db) WHERE k <= 10)"""


def half_graphs(spark, sf):
    e = embedding_dims(spark, sf)
    half = lambda start: e.select("vec_id", F.slice("x", start, 32).alias("x"))
    a, b = half(1), half(33)
    return e, NB.nearest_neighbors(a, a, 10), NB.nearest_neighbors(b, b, 10)


@query("compare_modality_graphs", "KNN-6 JOI-10 AGG-10", f"""
WITH {HALF_SQL}, u AS (SELECT coalesce(ga.src, gb.src) AS src, coalesce(ga.dst, gb.dst) AS dst, CAST(ga.src IS NOT NULL AS INTEGER) AS a, CAST(gb.src IS NOT NULL AS INTEGER) AS b
  FROM ga FULL JOIN gb ON ga.src = gb.src AND ga.dst = gb.dst),
t AS (SELECT a, b, CAST(x.label < 5 AS INTEGER) AS gs, CAST(y.label < 5 AS INTEGER) AS gd FROM u JOIN e x ON x.vec_id = src JOIN e y ON y.vec_id = dst)
SELECT CAST(sum(abs(a - b)) AS BIGINT) AS n_different, CAST(sum(a) FILTER (gs = 0 AND gd = 0) AS BIGINT) AS inner0_a, CAST(sum(a) FILTER (gs = 1 AND gd = 1) AS BIGINT) AS inner1_a, CAST(sum(a) FILTER (gs <> gd) AS BIGINT) AS outer_a,
  CAST(sum(b) FILTER (gs = 0 AND gd = 0) AS BIGINT) AS inner0_b, CAST(sum(b) FILTER (gs = 1 AND gd = 1) AS BIGINT) AS inner1_b, CAST(sum(b) FILTER (gs <> gd) AS BIGINT) AS outer_b FROM t""")
def compare_modality_graphs(spark, sf):
    e, a, b = half_graphs(spark, sf)
    gate = e.select("vec_id", F.when(F.col("label") < 5, 1).otherwise(0).alias("gate"))
    return NB.compare_graphs(a, b, gate)


@query("neighbour_label_audit", "KNN-5", f"""
WITH {HALF_SQL}, m AS (SELECT vec_id FROM e WHERE label = 3), n AS (SELECT DISTINCT dst FROM ga WHERE src IN (SELECT vec_id FROM m) AND dst NOT IN (SELECT vec_id FROM m))
SELECT label, count(*) AS n, round(avg(v[1]), 6) + 0.0 AS mean_first FROM e WHERE vec_id IN (SELECT dst FROM n) GROUP BY label""")
def neighbour_label_audit(spark, sf):
    e = embedding_dims(spark, sf)
    half = e.select("vec_id", F.slice("x", 1, 32).alias("x"))
    edges = NB.nearest_neighbors(half, half, 10)
    audit = NB.neighbour_audit(edges, e.filter("label = 3"), e)
    return audit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.element_at("x", 1))).alias("mean_first"))


# ---------------------------------------------------------------- evaluation

PAIR_SQL = """p AS (SELECT label AS truth, CAST(embedding[1] > 0 AS INTEGER) * 2 + CAST(embedding[2] > 0 AS INTEGER) AS pred FROM embeddings),
c AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT truth, sum(n) AS a FROM c GROUP BY truth), b AS (SELECT pred, sum(n) AS b FROM c GROUP BY pred), t AS (SELECT CAST(sum(n) AS DOUBLE) AS tot FROM c)"""


def two_labellings(spark, sf):
    bit = lambda i: (F.element_at("x", i) > 0).cast("int")
    e = embedding_dims(spark, sf).select("label", (bit(1) * 2 + bit(2)).alias("pred"))
    return E.contingency(e, "label", "pred")


@query("contingency_table", "EVL-1", f"WITH {PAIR_SQL} SELECT truth, pred, n FROM c")
def contingency_table(spark, sf):
    return two_labellings(spark, sf)


@query("rand_and_adjusted_rand", "EVL-2 EVL-3", f"""
WITH {PAIR_SQL}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(a * (a - 1) / 2) FROM a) AS ta, (SELECT sum(b * (b - 1) / 2) FROM b) AS tb, tot * (tot - 1) / 2 AS t FROM t)
SELECT round((t + 2 * x - ta - tb) / t, 6) AS rand, round((x - ta * tb / t) / ((ta + tb) / 2 - ta * tb / t), 6) AS adjusted_rand FROM s""")
def rand_and_adjusted_rand(spark, sf):
    return rounded(E.rand_indices(two_labellings(spark, sf)), "rand", "adjusted_rand")


@query("adjusted_mutual_information", "EVL-4", f"""
WITH {PAIR_SQL}, mi AS (SELECT sum(n / tot * ln(tot * n / (a * b))) AS mi FROM c JOIN a USING (truth) JOIN b USING (pred), t),
ht AS (SELECT -sum(a / tot * ln(a / tot)) AS h FROM a, t), hp AS (SELECT -sum(b / tot * ln(b / tot)) AS h FROM b, t),
x AS (SELECT a, b, tot, unnest(range(CAST(greatest(1, a + b - tot) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS x FROM a, b, t),
e AS (SELECT sum(x / tot * ln(tot * x / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(tot - a + 1) + lgamma(tot - b + 1) - lgamma(tot + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(tot - a - b + x + 1))) AS e FROM x)
SELECT round(mi, 6) AS mi, round(e, 6) AS emi, round((mi - e) / ((ht.h + hp.h) / 2 - e), 6) AS adjusted_mutual_info FROM mi, ht, hp, e""")
def adjusted_mutual_information(spark, sf):
    return rounded(E.adjusted_mutual_info(two_labellings(spark, sf)), "mi", "emi", "adjusted_mutual_info")


@query("side_separation_audit", "EVL-5", """
WITH e AS (SELECT vec_id, label // 2 AS node, CASE label % 2 WHEN 0 THEN 'L' ELSE 'R' END AS side, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
d AS (SELECT a.node, a.side || b.side AS kind, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.node = b.node)
SELECT CAST(node AS INTEGER) AS node_id, (SELECT count(*) FROM e WHERE e.node = d.node AND side = 'L') AS n_left, (SELECT count(*) FROM e WHERE e.node = d.node AND side = 'R') AS n_right,
  round(avg(d) FILTER (kind = 'LL'), 6) AS within_left, round(avg(d) FILTER (kind = 'RR'), 6) AS within_right, round(avg(d) FILTER (kind = 'LR'), 6) AS across,
  round(greatest((avg(d) FILTER (kind = 'LL') + avg(d) FILTER (kind = 'RR')) / 2 - avg(d) FILTER (kind = 'LR') + 1, 0), 6) AS hinge FROM d GROUP BY node""")
def side_separation_audit(spark, sf):
    e = embedding_dims(spark, sf).select("vec_id", F.floor(F.col("label") / 2).cast("int").alias("node_id"),
                                         F.when(F.col("label") % 2 == 0, "L").otherwise("R").alias("side"), "x")
    s = E.separation_hinge(E.side_separation(e, "node_id", "side", "x", "vec_id"))
    return rounded(s, "within_left", "within_right", "across", "hinge")


@query("nested_separation_audit", "EVL-5", """
WITH e AS (SELECT vec_id, label // 4 AS node, list_extract(['LL', 'LR', 'RL', 'RR'], label % 4 + 1) AS q, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
d AS (SELECT a.node, a.q AS a, b.q AS b, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.node = b.node),
c AS (SELECT node, 'L' AS child, avg(d) FILTER (a = 'LL' AND b = 'LR') AS inner_, avg(d) FILTER (a = 'LL' AND b IN ('RL', 'RR')) AS outer_ FROM d GROUP BY node
  UNION ALL SELECT node, 'R', avg(d) FILTER (a = 'RL' AND b = 'RR'), avg(d) FILTER (a = 'RR' AND b IN ('LL', 'LR')) FROM d GROUP BY node)
SELECT CAST(node AS INTEGER) AS node_id, child, round(inner_, 6) AS "inner", round(outer_, 6) AS "outer", round(greatest(inner_ - outer_ + 1, 0), 6) AS shortfall
FROM c""")
def nested_separation_audit(spark, sf):
    quarter = F.element_at(F.array(*[F.lit(q) for q in ("LL", "LR", "RL", "RR")]), (F.col("label") % 4 + 1).cast("int"))
    e = embedding_dims(spark, sf).select("vec_id", F.floor(F.col("label") / 4).cast("int").alias("node_id"), quarter.alias("q"), "x")
    return rounded(E.nested_separation(e, "node_id", "q", "x", "vec_id"), "inner", "outer", "shortfall")


@query("batch_centroid_alignment", "EVL-6", """
WITH e AS (SELECT CAST(vec_id % 3 AS INTEGER) AS batch, CAST(label // 2 AS INTEGER) AS node_id, CASE label % 2 WHEN 0 THEN 'L' ELSE 'R' END AS side, unnest(range(1, 65)) AS dim, unnest(embedding) AS v FROM embeddings),
c AS (SELECT node_id, side, batch, dim, avg(CAST(v AS DOUBLE)) AS c FROM e GROUP BY ALL),
p AS (SELECT a.node_id, a.side, a.batch AS b1, b.batch AS b2, sqrt(sum((a.c - b.c) ** 2)) AS d FROM c a JOIN c b ON a.node_id = b.node_id AND a.side = b.side AND a.dim = b.dim AND a.batch < b.batch GROUP BY ALL)
SELECT node_id, side, (SELECT count(DISTINCT batch) FROM c WHERE c.node_id = p.node_id AND c.side = p.side) AS n_batches, round(avg(d), 6) AS centroid_gap FROM p GROUP BY node_id, side""")
def batch_centroid_alignment(spark, sf):
    e = embedding_dims(spark, sf).select(
        (F.col("vec_id") % 3).cast("int").alias("batch"), F.floor(F.col("label") / 2).cast("int").alias("node_id"),
        F.when(F.col("label") % 2 == 0, "L").otherwise("R").alias("side"), "x")
    return rounded(E.batch_alignment(e, "node_id", "side", "batch", "x"), "centroid_gap")
