"""Queries over sources, projections, filters, normalisation, joins, aggregates, windows and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from markertree.functions.stats import array_norm
from markertree.operators import moments as M
from markertree.operators import normalize as N
from markertree.operators import qc as Q
from markertree.operators import select as S
from markertree.operators.quantiles import exact_quantiles
from markertree.plans.registry import EVENTS_SQL, LINE_SQL, LONG_SQL, TOKENS_SQL, query, r, rounded
from markertree.session import shared_folder
from markertree.sources import readers as R
from markertree.sources import writers as W
from markertree.sources.tables import (
    MARKERS, embedding_dims, event_counts, line_cells, line_long, table, token_counts,
)


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

@query("csv_marker_table", "SRC-1 SNK-1", f"""
WITH {LINE_SQL} SELECT batch_n.cell_id, qty, price FROM cells batch_n""")
def csv_marker_table(spark, sf):
    path = scratch(spark, "marker-csv")
    W.write_table(line_cells(spark, sf).select("cell_id", "qty", "price"), path, "csv")
    return R.read_marker_table(spark, path).select("cell_id", "qty", "price")


@query("tsv_transposed_table", "SRC-2 SRC-3", """
SELECT feature, CAST(d AS VARCHAR) AS cell_id, CAST((SELECT count(*) FROM events WHERE event_type = feature AND day(ts) = d) AS DOUBLE) AS value
FROM (SELECT DISTINCT event_type AS feature FROM events), range(1, 32) t(d)""")
def tsv_transposed_table(spark, sf):
    """Feature x cell file whose cells are the days of the month (a fixed, short list of columns)."""
    days = [str(d) for d in range(1, 32)]
    events = table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.dayofmonth("ts").cast("string").alias("day"))
    wide = events.groupBy("feature").pivot("day", days).agg(F.count(F.lit(1)).cast("double")).fillna(0.0)
    path = scratch(spark, "transposed")
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return R.read_transposed_table(spark, path)


@query("headerless_labels", "SRC-4 SNK-2", """
SELECT CAST(vec_id AS VARCHAR) AS cell_id, concat(label, '_leaf') AS label FROM embeddings""")
def headerless_labels(spark, sf):
    path = scratch(spark, "labels")
    labels = embedding_dims(spark, sf).select(F.col("vec_id").cast("string"), F.concat("label", F.lit("_leaf")))
    labels.write.csv(path)
    return R.read_labels(spark, path)


@query("sparse_matrix_store", "SRC-5", f"""
WITH {EVENTS_SQL} SELECT cell_id, feature, value FROM counts""")
def sparse_matrix_store(spark, sf):
    path = scratch(spark, "matrix")
    W.write_table(event_counts(spark, sf), path)
    return spark.read.parquet(path).select("cell_id", "feature", "value")


VIEWS_SQL = """triplets AS (
  SELECT event_type AS view, user_id AS "row", CAST(day(ts) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY ALL)"""


def event_views(spark, sf):
    return table(spark, sf, "events").groupBy(
        F.col("event_type").alias("view"), F.col("user_id").alias("row"),
        F.dayofmonth("ts").cast("bigint").alias("col"),
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("views_complete_rows", "SRC-6", f"""
WITH {VIEWS_SQL}, ok AS (
  SELECT "row" FROM triplets GROUP BY "row"
  HAVING count(DISTINCT view) = (SELECT count(DISTINCT view) FROM triplets))
SELECT view, "row", col, value FROM triplets WHERE "row" IN (SELECT "row" FROM ok)""")
def views_complete_rows(spark, sf):
    path = scratch(spark, "views")
    W.write_table(event_views(spark, sf), path)
    return R.read_views(spark, path, only_complete_rows=True)


@query("split_by_feature_type", "SRC-7", f"""
WITH {LONG_SQL} SELECT batch, cell_id, feature, value FROM long WHERE feature IN ('disc', 'tax')""")
def split_by_feature_type(spark, sf):
    features = spark.createDataFrame(
        [("qty", "amount"), ("price", "amount"), ("disc", "rate"), ("tax", "rate")], "feature string, feature_type string"
    )
    return R.split_by_type(line_long(spark, sf), features, "rate").select("batch", "cell_id", "feature", "value")


@query("batch_partitions", "SRC-8 SRC-9", f"""
WITH {LINE_SQL} SELECT batch, count(*) AS n, round(sum(qty), 2) AS qty FROM cells GROUP BY batch""")
def batch_partitions(spark, sf):
    path = scratch(spark, "batches")
    W.write_table(line_cells(spark, sf), path, partition_by=["batch"])
    files = R.read_batches(spark, f"{path}/batch=*", pattern=r"batch=([^/]+)/")
    return files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 2).alias("qty"))


@query("unique_part_names", "SRC-10", """
SELECT p_partkey, p_name, CASE WHEN nth = 0 THEN p_name ELSE concat_ws('-', p_name, nth) END AS unique_name
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS nth FROM part)""")
def unique_part_names(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return R.unique_feature_names(part, "p_name", "p_partkey")


@query("raw_count_detector", "SRC-11", f"""
WITH {LONG_SQL} SELECT batch, feature, bool_and(value = round(value)) AS is_raw, count(*) AS n_values
FROM long GROUP BY batch, feature""")
def raw_count_detector(spark, sf):
    return R.looks_raw(line_long(spark, sf), ["batch", "feature"])


@query("weight_matrix_feature_by_node", "SNK-3", f"""
SELECT event_type AS feature, {", ".join(f'round(coalesce(avg(value) FILTER (isodow(ts) = {d}), 0), 6) AS "{d}"' for d in range(1, 8))}
FROM events GROUP BY event_type""")
def weight_matrix_feature_by_node(spark, sf):
    weights = table(spark, sf, "events").select(
        F.col("event_type").alias("feature"), (F.weekday("ts") + 1).alias("node_id"), "value"
    ).groupBy("feature", "node_id").agg(r(F.avg("value")).alias("w"))
    path = scratch(spark, "weights")
    W.write_table(W.weight_matrix(weights, list(range(1, 8))), path)
    return spark.read.parquet(path)


@query("feature_masks", "SNK-7", f"""
WITH {EVENTS_SQL} SELECT DISTINCT feature, 1 AS value FROM counts""")
def feature_masks(spark, sf):
    return W.feature_mask(event_counts(spark, sf))


@query("cells_with_label_export", "SNK-8", """
SELECT d.doc_id, n_chars FROM documents d JOIN labels USING (doc_id) WHERE quality = 1""")
def cells_with_label_export(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    path = scratch(spark, "subset")
    W.write_table(W.cells_with_label(table(spark, sf, "documents").select("doc_id", "n_chars"), labels, "1", "doc_id"), path)
    return spark.read.parquet(path)


@query("benchmark_log", "SNK-9 AGG-17", """
SELECT p_brand AS db, p_type AS method, round(avg(p_retailprice) / 60, 6) AS minutes, round(avg(p_size), 6) AS n_component
FROM part WHERE p_type <> 'PROMO' GROUP BY ALL""")
def benchmark_log(spark, sf):
    part = table(spark, sf, "part")
    path = scratch(spark, "records")
    base = part.select(F.col("p_brand").alias("db"), F.col("p_type").alias("method"),
                       F.col("p_retailprice").alias("time"), F.col("p_size").alias("n_component"))
    W.append_records(spark, base.filter("n_component % 2 = 0"), path)
    log = W.append_records(spark, base.filter("n_component % 2 = 1"), path)
    from markertree.operators.evaluate import benchmark_averages

    return rounded(benchmark_averages(log, exclude=["PROMO"]), "minutes", "n_component")


# ---------------------------------------------------------------- projections and filters

@query("marker_subset", "PRJ-1 FLT-2", f"""
WITH {LINE_SQL} SELECT cell_id, qty, price FROM cells WHERE batch = 'R'""")
def marker_subset(spark, sf):
    return line_cells(spark, sf).filter(F.col("batch") == "R").select("cell_id", "qty", "price")


@query("drop_constant_features", "PRJ-2", f"""
WITH {LONG_SQL}, wide AS (SELECT * FROM long UNION ALL SELECT batch, cell_id, 'one', 1.0 FROM cells)
SELECT feature, count(*) AS n FROM wide GROUP BY feature HAVING max(value) > min(value)""")
def drop_constant_features(spark, sf):
    long = line_long(spark, sf)
    one = line_cells(spark, sf).select("batch", "cell_id", F.lit("one").alias("feature"), F.lit(1.0).alias("value"))
    return Q.varying_features(long.unionByName(one)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("component_columns", "PRJ-3", """
SELECT vec_id, concat('PC', i) AS feature, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value
FROM embeddings, range(5) t(i)""")
def component_columns(spark, sf):
    five = embedding_dims(spark, sf).select("vec_id", F.slice("x", 1, 5).alias("x"))
    return rounded(S.component_names(five, "x", "PC", ["vec_id"]), "value")


@query("candidate_markers", "PRJ-4 JOI-9", f"""
WITH {LONG_SQL}, c AS (SELECT DISTINCT feature FROM long WHERE feature NOT IN ('tax'))
SELECT a.feature AS f1, b.feature AS f2 FROM c a JOIN c b ON a.feature < b.feature""")
def candidate_markers(spark, sf):
    found = line_long(spark, sf).select("feature").distinct()
    left = S.candidate_features(found, parent_key=["tax"])
    pairs = left.select(F.col("feature").alias("f1")).join(left.select(F.col("feature").alias("f2")), F.col("f1") < F.col("f2"))
    return pairs


@query("rekeyed_ids", "PRJ-5 PRJ-6", """
SELECT c_custkey, concat(substring(c_name, 1, length(c_name) - 2), '.1') AS new_id, 'query' AS role FROM customer""")
def rekeyed_ids(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", S.rekey("c_name", ".1").alias("new_id"), F.lit("query").alias("role")
    )


@query("composite_labels", "PRJ-7", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('[', o_custkey % 4, ']')
   WHEN o_orderkey % 3 = 1 THEN concat('[', o_custkey % 4, '][', o_orderkey % 4, ']')
   ELSE concat('[', o_custkey % 4, '][', o_orderkey % 4, '][5]') END AS code FROM orders)
SELECT o_orderkey, CASE WHEN length(code) > 7 THEN 'multi(>2)'
  WHEN length(code) = 6 AND substring(code, 2, 1) = substring(code, 5, 1) THEN substring(code, 1, 3) ELSE code END AS label FROM t""")
def composite_labels(spark, sf):
    o = table(spark, sf, "orders")
    one = F.concat(F.lit("["), (F.col("o_custkey") % 4).cast("string"), F.lit("]"))
    two = F.concat(one, F.lit("["), (F.col("o_orderkey") % 4).cast("string"), F.lit("]"))
    code = F.when(F.col("o_orderkey") % 3 == 0, one).when(F.col("o_orderkey") % 3 == 1, two).otherwise(F.concat(two, F.lit("[5]")))
    return o.withColumn("code", code).select("o_orderkey", S.recode_composite("code").alias("label"))


@query("null_label_sentinel", "PRJ-8 JOI-2", """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '30_noclass') AS label FROM documents d LEFT JOIN labels USING (doc_id)""")
def null_label_sentinel(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", S.null_to("quality", "30_noclass").alias("label"))


@query("semi_join_members", "FLT-1 JOI-3", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_members(spark, sf):
    members = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.keep_members(table(spark, sf, "orders"), members, "o_custkey").select("o_orderkey", "o_totalprice")


@query("threshold_gating", "FLT-3", f"""
WITH {LINE_SQL} SELECT cell_id, CASE WHEN qty < 10 AND disc > 0.05 THEN 1 ELSE 0 END AS gate FROM cells""")
def threshold_gating(spark, sf):
    return line_cells(spark, sf).select("cell_id", S.gate([F.col("qty") < 10, F.col("disc") > 0.05]).alias("gate"))


@query("anti_join_unassigned", "FLT-4 JOI-4", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_join_unassigned(spark, sf):
    return S.drop_members(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("shuffled_cells", "FLT-6", f"WITH {LINE_SQL} SELECT cell_id, batch FROM cells")
def shuffled_cells(spark, sf):
    return S.hashed_order(line_cells(spark, sf).select("cell_id", "batch"), 7, "cell_id")


# ---------------------------------------------------------------- normalisation and QC

@query("clr_per_marker", "NRM-1 NRM-3", f"""
WITH {LONG_SQL}, c AS (SELECT batch, feature, avg(ln(value + 1)) AS m FROM long GROUP BY ALL)
SELECT cell_id, feature, round(ln(value + 1) - m, 6) + 0.0 AS value FROM long JOIN c USING (batch, feature)""")
def clr_per_marker(spark, sf):
    return N.clr_by_feature(line_long(spark, sf)).select("cell_id", "feature", r("value").alias("value"))


@query("clr_per_cell", "NRM-1", f"""
WITH {EVENTS_SQL} SELECT cell_id, feature, round(ln(value + 1) - avg(ln(value + 1)) OVER (PARTITION BY cell_id), 6) + 0.0 AS value FROM counts""")
def clr_per_cell(spark, sf):
    return rounded(N.clr_by_cell(event_counts(spark, sf)).select("cell_id", "feature", "value"), "value")


@query("depth_normalized_log", "NRM-2 NRM-3", f"""
WITH {TOKENS_SQL} SELECT cell_id, feature, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM tokens""")
def depth_normalized_log(spark, sf):
    scaled = N.depth_normalize(token_counts(spark, sf))
    return rounded(N.log_transform(scaled).select("cell_id", "feature", "value"), "value")


@query("log_family", "NRM-3", f"""
WITH {EVENTS_SQL} SELECT cell_id, feature, round(ln(1 + value), 6) AS l1p, round(log2(value), 6) AS l2,
  round(exp(value / 100) - 1, 6) AS em1, round(exp(-value / 100), 6) AS ex FROM counts""")
def log_family(spark, sf):
    c = event_counts(spark, sf)
    hundredth = c.withColumn("value", F.col("value") / 100)
    on = ["cell_id", "feature"]
    part = lambda df, kind, name: N.log_transform(df, kind).select(*on, r("value").alias(name))
    negative = hundredth.withColumn("value", -F.col("value"))
    return part(c, "log1p", "l1p").join(part(c, "log2", "l2"), on).join(part(hundredth, "expm1", "em1"), on).join(
        part(negative, "exp", "ex"), on)


@query("zscore_clipped", "NRM-4", f"""
WITH {LONG_SQL}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY feature)
SELECT cell_id, feature, round(greatest(least((value - m) / sd, 1.5), -1.5), 6) + 0.0 AS value FROM long JOIN s USING (feature)""")
def zscore_clipped(spark, sf):
    return N.zscore(line_long(spark, sf), clip=1.5).select("cell_id", "feature", r("value").alias("value"))


@query("scaled_without_centre", "NRM-4", f"""
WITH {LONG_SQL}, s AS (SELECT batch, feature, stddev_samp(value) AS sd FROM long GROUP BY ALL)
SELECT cell_id, feature, round(least(value / sd, 10), 6) + 0.0 AS value FROM long JOIN s USING (batch, feature)""")
def scaled_without_centre(spark, sf):
    z = N.zscore(line_long(spark, sf), by=["batch"], centre=False)
    return z.select("cell_id", "feature", r("value").alias("value"))


@query("rounded_counts", "NRM-5", f"""
WITH {LINE_SQL} SELECT cell_id, round_even(price / 7, 0) AS value FROM cells""")
def rounded_counts(spark, sf):
    v = line_cells(spark, sf).select("cell_id", (F.col("price") / 7).alias("value"))
    return N.round_counts(v)


@query("unit_vectors", "NRM-6", """
WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_sum([x * x for x in v])), 6) + 0.0 AS first,
  round(list_sum(v) / sqrt(list_sum([x * x for x in v])), 6) + 0.0 AS total FROM e""")
def unit_vectors(spark, sf):
    unit = N.l2_normalize(embedding_dims(spark, sf), "x")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return unit.select("vec_id", r(F.element_at("x", 1)).alias("first"), r(total).alias("total"))


NODE_WEIGHTS_SQL = """weights AS (
  SELECT CAST(isodow(ts) AS BIGINT) AS node_id, event_type AS feature, avg(value) AS w FROM events GROUP BY ALL)"""


def event_weights(spark, sf):
    return table(spark, sf, "events").groupBy(
        (F.weekday("ts") + 1).cast("bigint").alias("node_id"), F.col("event_type").alias("feature")
    ).agg(F.avg("value").alias("w"))


@query("scaled_node_weights", "NRM-7 NRM-8", f"""
WITH {NODE_WEIGHTS_SQL}, z AS (SELECT node_id, feature, (w - avg(w) OVER p) / stddev_pop(w) OVER p AS w FROM weights WINDOW p AS (PARTITION BY node_id))
SELECT node_id, feature, round(w * (log2(2 * node_id + 1) + 1) / 10, 6) + 0.0 AS w FROM z""")
def scaled_node_weights(spark, sf):
    return rounded(N.depth_scaled_weights(N.standardize_weights(event_weights(spark, sf))).select("node_id", "feature", "w"), "w")


@query("smoothed_markers", "NRM-9")
def smoothed_markers(spark, sf):
    return N.smooth(line_long(spark, sf), seed=11).select("batch", "cell_id", "feature", "value")


@query("detected_cells_and_features", "QC-1 QC-2", f"""
WITH {TOKENS_SQL}, c AS (SELECT cell_id FROM tokens GROUP BY cell_id HAVING count(*) FILTER (value > 0) >= 20),
t1 AS (SELECT * FROM tokens WHERE cell_id IN (SELECT cell_id FROM c)),
f AS (SELECT feature FROM t1 GROUP BY feature HAVING count(*) FILTER (value > 0) >= 3)
SELECT cell_id, feature, value FROM t1 WHERE feature IN (SELECT feature FROM f)""")
def detected_cells_and_features(spark, sf):
    kept = Q.cells_with_features(token_counts(spark, sf), 20)
    return Q.features_in_cells(kept, 3).select("cell_id", "feature", "value")


@query("cell_quality_metrics", "QC-3 QC-4 QC-5", f"""
WITH {TOKENS_SQL}, m AS (SELECT cell_id, count(*) FILTER (value > 0) AS n_features, sum(value) AS total,
  sum(CASE WHEN starts_with(feature, 'e') THEN value ELSE 0 END) AS total_flagged FROM tokens GROUP BY cell_id)
SELECT cell_id, n_features, total, total_flagged, round(100 * total_flagged / total, 6) AS pct_flagged FROM m
WHERE n_features < 3000 AND 100 * total_flagged / total < 10""")
def cell_quality_metrics(spark, sf):
    tokens = Q.flag_by_prefix(token_counts(spark, sf), "e")
    metrics = Q.cell_metrics(tokens, F.col("flagged"))
    return rounded(Q.healthy_cells(metrics), "pct_flagged")


@query("iqr_outlier_filter", "QC-6", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT c_custkey, c_acctbal FROM customer, q
WHERE c_acctbal > a - 0.2 * (b - a) AND c_acctbal < b + 0.2 * (b - a)""")
def iqr_outlier_filter(spark, sf):
    cells = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return Q.iqr_outliers(cells, "c_custkey", ["c_acctbal"], factor=0.2, max_drop=None, min_left=None)["cells"]


@query("iqr_outlier_fallback", "QC-6", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1))
  AND o_orderkey NOT IN (SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1))""")
def iqr_outlier_fallback(spark, sf):
    cells = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Q.iqr_outliers(cells, "o_orderkey", ["o_totalprice"], factor=0.1)["cells"]


@query("distinct_values_per_marker", "QC-7", f"""
WITH {LONG_SQL} SELECT batch, feature, count(DISTINCT value) AS n_unique FROM long GROUP BY ALL""")
def distinct_values_per_marker(spark, sf):
    return Q.distinct_counts(line_long(spark, sf), ["batch"])


@query("dense_core_of_leaf", "QC-8", f"""
WITH {LINE_SQL}, m AS (SELECT batch, avg(qty) ma, avg(price) mb, var_samp(qty) va, var_samp(price) vb, covar_samp(qty, price) c FROM cells GROUP BY batch),
d AS (SELECT batch, cell_id, -ln(2 * pi()) - 0.5 * ln(va * vb - c * c)
   - 0.5 * (vb * (qty - ma) ** 2 - 2 * c * (qty - ma) * (price - mb) + va * (price - mb) ** 2) / (va * vb - c * c) AS ld FROM cells JOIN m USING (batch)),
q AS (SELECT batch, quantile_cont(ld, 0.25) AS f FROM d GROUP BY batch)
SELECT cell_id, round(ld, 6) AS log_density FROM d JOIN q USING (batch) WHERE ld > f""")
def dense_core_of_leaf(spark, sf):
    core = Q.dense_core(line_cells(spark, sf), "batch", ["qty", "price"])
    return core.select("cell_id", r("log_density").alias("log_density"))


@query("spread_guard", "QC-9", f"""
WITH {LINE_SQL} SELECT batch, qty > 25 AS side, round(least(max(qty) - min(qty), max(disc) - min(disc)), 6) AS min_range,
  least(max(qty) - min(qty), max(disc) - min(disc)) < ln(3) AS too_discrete FROM cells GROUP BY ALL""")
def spread_guard(spark, sf):
    cells = line_cells(spark, sf).withColumn("side", F.col("qty") > 25)
    return rounded(Q.spread_guard(cells, ["qty", "disc"], ["batch", "side"]), "min_range")


@query("value_sanity_report", "QC-10", """
SELECT round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, max(c_acctbal) AS max, min(c_acctbal) AS min,
  round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 6) AS positive_share FROM customer""")
def value_sanity_report(spark, sf):
    return rounded(Q.sanity_report(table(spark, sf, "customer"), "c_acctbal"), "mean", "sd", "positive_share")


@query("exact_quantiles_by_batch", "QC-6 AGG-18", f"""
WITH {LONG_SQL} SELECT batch, feature, round(quantile_cont(value, 0.25), 6) AS q0, round(median(value), 6) AS q1,
  round(quantile_cont(value, 0.9), 6) AS q2 FROM long GROUP BY ALL""")
def exact_quantiles_by_batch(spark, sf):
    q = exact_quantiles(line_long(spark, sf), ["batch", "feature"], "value", [0.25, 0.5, 0.9])
    return rounded(q, "q0", "q1", "q2")


# ---------------------------------------------------------------- joins

@query("modality_alignment", "JOI-1 JOI-7", """
SELECT vec_id, label, n_chars, round(CAST(embedding[1] AS DOUBLE) + ln(1 + n_chars), 6) AS combined
FROM embeddings JOIN documents ON vec_id = doc_id""")
def modality_alignment(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    both = embedding_dims(spark, sf).join(docs, "vec_id").withColumn("x", F.concat("x", F.array(F.log1p("n_chars"))))
    return both.select("vec_id", "label", "n_chars", r(F.element_at("x", 1) + F.element_at("x", -1)).alias("combined"))


@query("sparse_projection", "JOI-5 DIM-2 XDS-11", f"""
WITH {TOKENS_SQL}, w AS (SELECT feature, ln(1 + sum(value)) / 10 AS w FROM tokens GROUP BY feature)
SELECT cell_id, round(sum(value * w), 5) AS h FROM tokens JOIN w USING (feature) GROUP BY cell_id""")
def sparse_projection(spark, sf):
    from markertree.operators.assign import project

    tokens = token_counts(spark, sf)
    weights = tokens.groupBy("feature").agg((F.log1p(F.sum("value")) / 10).alias("w"))
    return rounded(project(tokens, weights, ["cell_id"]), "h", digits=5)


@query("shared_features_union", "JOI-6 SET-1 SET-3", f"""
WITH {TOKENS_SQL}, f AS (SELECT feature FROM tokens GROUP BY feature HAVING count(DISTINCT batch) = (SELECT count(DISTINCT batch) FROM tokens))
SELECT batch, count(DISTINCT feature) AS n_features, sum(value) AS total FROM tokens WHERE feature IN (SELECT feature FROM f) GROUP BY batch""")
def shared_features_union(spark, sf):
    shared = S.union_shared(token_counts(spark, sf))
    per = shared.groupBy("batch", "feature").agg(F.sum("value").alias("value"))
    return per.groupBy("batch").agg(F.count(F.lit(1)).alias("n_features"), F.sum("value").alias("total"))


# ---------------------------------------------------------------- aggregates

@query("group_moments", "AGG-1 UDF-3", f"""
WITH {LINE_SQL} SELECT batch, count(*) AS n, round(avg(qty), 6) AS mean_qty, round(avg(price), 4) AS mean_price, round(avg(disc), 6) AS mean_disc,
  round(var_samp(qty), 6) AS var_qty, round(var_samp(price), 1) AS var_price, round(var_samp(disc), 6) AS var_disc,
  round(covar_samp(qty, price), 3) AS cov_qty_price, round(covar_samp(qty, disc), 6) AS cov_qty_disc, round(covar_samp(price, disc), 4) AS cov_price_disc
FROM cells GROUP BY batch""")
def group_moments(spark, sf):
    m = M.moments(line_cells(spark, sf), ["batch"], ["qty", "price", "disc"])
    m = rounded(m, "mean_qty", "mean_disc", "var_qty", "var_disc", "cov_qty_disc")
    m = rounded(rounded(m, "mean_price", "cov_price_disc", digits=4), "cov_qty_price", digits=3)
    return rounded(m, "var_price", digits=1)


@query("weighted_group_moments", "AGG-2", f"""
WITH {LINE_SQL}, m AS (SELECT batch, sum(tax) AS weight, sum(tax * qty) / sum(tax) AS mq, sum(tax * disc) / sum(tax) AS md FROM cells GROUP BY batch)
SELECT batch, round(min(weight), 4) AS weight, round(min(mq), 6) AS mean_qty, round(min(md), 6) AS mean_disc,
  round(sum(tax * (qty - mq) ** 2) / sum(tax), 6) AS var_qty, round(sum(tax * (disc - md) ** 2) / sum(tax), 6) AS var_disc,
  round(sum(tax * (qty - mq) * (disc - md)) / sum(tax), 6) + 0.0 AS cov_qty_disc FROM cells JOIN m USING (batch) GROUP BY batch""")
def weighted_group_moments(spark, sf):
    m = M.weighted_moments(line_cells(spark, sf), ["batch"], ["qty", "disc"], "tax")
    return rounded(rounded(m, "mean_qty", "mean_disc", "var_qty", "var_disc", "cov_qty_disc"), "weight", digits=4)


@query("population_moments", "AGG-3 MIX-9", f"""
WITH {LONG_SQL} SELECT batch, feature, count(*) AS n, round(avg(value), 4) AS mean_value, round(var_pop(value), 2) AS var_value FROM long GROUP BY ALL""")
def population_moments(spark, sf):
    m = M.moments(line_long(spark, sf), ["batch", "feature"], ["value"], ddof=0)
    return rounded(rounded(m, "mean_value", digits=4), "var_value", digits=2)


@query("top_frequencies", "AGG-4", f"""
WITH {TOKENS_SQL} SELECT feature, count(*) AS n FROM tokens GROUP BY feature ORDER BY n DESC, feature LIMIT 20""")
def top_frequencies(spark, sf):
    return M.frequency(token_counts(spark, sf), "feature", 20)


@query("leaf_summary", "AGG-5", f"""
WITH {LINE_SQL}, l AS (SELECT *, concat(batch, CAST(qty > 25 AS INTEGER)) AS leaf FROM cells)
SELECT leaf, count(*) AS n, round(avg(qty), 6) AS mean_qty, round(avg(disc), 6) AS mean_disc,
  round(count(*) / (SELECT count(*) FROM l), 6) AS proportion FROM l GROUP BY leaf""")
def leaf_summary(spark, sf):
    cells = line_cells(spark, sf).withColumn("leaf", F.concat("batch", (F.col("qty") > 25).cast("int").cast("string")))
    return rounded(M.leaf_summary(cells, "leaf", ["qty", "disc"]), "mean_qty", "mean_disc", "proportion")


@query("right_wrong_means", "AGG-9", f"""
WITH {LINE_SQL} SELECT round(avg(qty) FILTER (batch = 'A'), 6) AS mean_true, round(avg(qty) FILTER (batch <> 'A'), 6) AS mean_false,
  round(avg(CASE WHEN qty > 30 THEN 1.0 ELSE 0 END) FILTER (batch = 'A'), 6) AS share_above_true,
  round(avg(CASE WHEN qty > 30 THEN 1.0 ELSE 0 END) FILTER (batch <> 'A'), 6) AS share_above_false FROM cells""")
def right_wrong_means(spark, sf):
    m = M.conditional_means(line_cells(spark, sf), "qty", F.col("batch") == "A", 30)
    return rounded(m, *m.columns)


@query("marker_correlations", "AGG-11", f"""
WITH {LINE_SQL} SELECT batch, round(corr(qty, price), 6) AS corr_qty_price, round(corr(disc, tax), 6) + 0.0 AS corr_disc_tax FROM cells GROUP BY batch""")
def marker_correlations(spark, sf):
    c = M.correlations(line_cells(spark, sf), ["batch"], [("qty", "price"), ("disc", "tax")])
    return rounded(c, "corr_qty_price", "corr_disc_tax")


@query("marker_density_histogram", "AGG-16 VIS-7", f"""
WITH {LONG_SQL}, lim AS (SELECT feature, min(value) lo, max(value) hi FROM long GROUP BY feature),
b AS (SELECT batch, feature, least(floor((value - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, (hi - lo) / 30 AS w FROM long JOIN lim USING (feature)),
c AS (SELECT batch, feature, bin, count(*) AS n, max(w) AS w FROM b GROUP BY ALL)
SELECT batch, feature, bin, n, round(n / sum(n) OVER (PARTITION BY batch, feature) / w, 9) AS density FROM c""")
def marker_density_histogram(spark, sf):
    return rounded(M.feature_histogram(line_long(spark, sf), ["batch"], 30), "density", digits=9)


# ---------------------------------------------------------------- windows and sets

@query("best_candidate_per_row", "WIN-1", f"""
WITH {EVENTS_SQL} SELECT cell_id, feature AS best FROM (
  SELECT cell_id, feature, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, feature) AS k FROM counts) WHERE k = 1""")
def best_candidate_per_row(spark, sf):
    return event_counts(spark, sf).groupBy("cell_id").agg(
        F.min(F.struct((-F.col("value")).alias("v"), F.col("feature")))["feature"].alias("best"))


@query("top_features_per_group", "WIN-2", f"""
WITH {TOKENS_SQL}, s AS (SELECT batch, feature, sum(value) AS value FROM tokens GROUP BY ALL)
SELECT batch, feature, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY value DESC, feature) AS rank FROM s) WHERE rank <= 10""")
def top_features_per_group(spark, sf):
    s = token_counts(spark, sf).groupBy("batch", "feature").agg(F.sum("value").alias("value"))
    return S.top_per_group(s, ["batch"], [F.desc("value"), F.asc("feature")], 10)


@query("extreme_loadings", "WIN-3", f"""
WITH {TOKENS_SQL}, s AS (SELECT batch, feature, sum(value) AS value FROM tokens GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY value DESC, feature) AS a, row_number() OVER (PARTITION BY batch ORDER BY value, feature) AS b FROM s)
SELECT batch, feature, value FROM k WHERE a <= 50 OR b <= 50""")
def extreme_loadings(spark, sf):
    s = token_counts(spark, sf).groupBy("batch", "feature").agg(F.sum("value").alias("value"))
    return S.extreme_features(s, ["batch"], "value", 50)


@query("leaf_size_cumulative", "WIN-4 VIS-9", """
WITH c AS (SELECT o_orderpriority AS leaf, count(*) AS n FROM orders GROUP BY ALL)
SELECT leaf, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n, round(sum(n) OVER w / (SELECT sum(n) FROM c), 6) AS cum_share
FROM c WINDOW w AS (ORDER BY n DESC, leaf ROWS UNBOUNDED PRECEDING)""")
def leaf_size_cumulative(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(S.cumulative_share(counts), "cum_share")


@query("batch_ranking", "WIN-5 DIM-3", """
WITH v AS (SELECT label AS batch, count(*) AS n, var_samp(CAST(embedding[1] AS DOUBLE)) + var_samp(CAST(embedding[2] AS DOUBLE)) AS v FROM embeddings GROUP BY label),
s AS (SELECT batch, v + (SELECT count(*) FROM v) * n / (SELECT sum(n) FROM v) AS score FROM v)
SELECT batch, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, batch) AS rank FROM s) WHERE rank <= 8""")
def batch_ranking(spark, sf):
    from markertree.operators.features import rank_batches

    e = embedding_dims(spark, sf).select(F.col("label").alias("batch"), F.element_at("x", 1).alias("c1"), F.element_at("x", 2).alias("c2"))
    return rounded(rank_batches(e, "batch", ["c1", "c2"], 8).select("batch", "score", "rank"), "score")


CURVE_SQL = """curve AS (
  SELECT o_orderpriority AS key, CAST(month(o_orderdate) AS INTEGER) AS k, avg(o_totalprice) AS bic FROM orders GROUP BY ALL)"""


@query("elbow_point", "WIN-7 MIX-4", f"""
WITH {CURVE_SQL}, e AS (SELECT key, k, bic, first_value(k) OVER w AS k0, last_value(k) OVER w AS k1, first_value(bic) OVER w AS v0, last_value(bic) OVER w AS v1
  FROM curve WINDOW w AS (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT key, k, bic, abs((v1 - v0) * (k - k0) - (k1 - k0) * (bic - v0)) / sqrt((v1 - v0) ** 2 + (k1 - k0) ** 2) AS d FROM e),
x AS (SELECT key, first(k ORDER BY bic, k) AS argmin, first(k ORDER BY d DESC, k) AS elbow FROM d GROUP BY key)
SELECT key, argmin, elbow, least(argmin, elbow) AS k_best FROM x""")
def elbow_point(spark, sf):
    curve = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("key"), F.month("o_orderdate").alias("k")).agg(F.avg("o_totalprice").alias("bic"))
    return S.choose_k(curve, ["key"])


@query("side_matrix_union", "SET-2 TRE-5 SNK-5", f"""
WITH {LINE_SQL} SELECT cell_id, CASE WHEN qty > 25 THEN 1 ELSE -1 END AS "0",
  CASE WHEN qty > 25 THEN 0 WHEN disc > 0.05 THEN 1 ELSE -1 END AS "1", CASE WHEN qty <= 25 THEN 0 WHEN tax > 0.04 THEN 1 ELSE -1 END AS "2" FROM cells""")
def side_matrix_union(spark, sf):
    from markertree.operators.treetables import side_matrix

    cells = line_cells(spark, sf)
    sign = lambda c: F.when(c, 1).otherwise(-1)
    root = cells.select("cell_id", F.lit(0).alias("node_id"), sign(F.col("qty") > 25).alias("side"))
    left = cells.filter("qty <= 25").select("cell_id", F.lit(1).alias("node_id"), sign(F.col("disc") > 0.05).alias("side"))
    right = cells.filter("qty > 25").select("cell_id", F.lit(2).alias("node_id"), sign(F.col("tax") > 0.04).alias("side"))
    long = root.unionByName(left).unionByName(right, allowMissingColumns=True)
    return side_matrix(long, [0, 1, 2])


@query("overlap_sizes", "SET-4 SET-5", """
WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 0)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS n_both,
  (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS n_only_a, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS n_only_b""")
def overlap_sizes(spark, sf):
    labels = table(spark, sf, "labels")
    return S.overlap(labels.filter("quality = 1"), labels.filter("toxic = 0"), "doc_id")


@query("held_out_rows", "CCA-7", """
SELECT vec_id, CASE WHEN vec_id < greatest(floor((SELECT count(*) FROM embeddings) * 0.8), 1) THEN 'train' ELSE 'test' END AS split FROM embeddings""")
def held_out_rows(spark, sf):
    return S.held_out_tail(embedding_dims(spark, sf).select("vec_id"), "vec_id", 0.2)
