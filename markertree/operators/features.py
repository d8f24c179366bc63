"""Differential features, variable features, batch ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.operators.select import extreme_features, top_per_group
from markertree.session import attach_row, lookup, sized


def welch_scores(long: DataFrame, groups: DataFrame, cell: list[str] = ("cell_id",), by: list[str] = ()) -> DataFrame:
    """Welch t of every feature, each group against all other cells, absent entries counted as zeros.

    ``groups`` gives each cell its group (and the optional ``by`` keys, for example node or batch).
    Sums are combined map-side; the number of cells per group fills in the zeros.
    """
    by = list(by)
    # the group table may carry keys (a node, say) that the value table lacks, and the other way round
    on = [*cell, *[k for k in by if k in long.columns and k in groups.columns]]
    tagged = long.join(lookup(groups), on)
    # read twice below; stored, so that the entries are summed once
    part = sized(tagged.groupBy(*by, "feature", "group").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")))
    sizes = groups.groupBy(*by, "group").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy(*by).agg(F.sum("n").alias("n_all")) if by else sizes.agg(F.sum("n").alias("n_all"))
    sizes = sizes.join(totals, by) if by else attach_row(sizes, totals)
    features = part.groupBy(*by, "feature").agg(F.sum("s").alias("s_all"), F.sum("ss").alias("ss_all"))
    # a feature absent from a group still competes there with mean zero
    grid = features.join(sizes, by) if by else features.join(F.broadcast(sizes))
    full = grid.join(part, [*by, "feature", "group"], "left").fillna(0.0, ["s", "ss"])
    n1, n0 = F.col("n"), F.col("n_all") - F.col("n")
    m1, m0 = F.col("s") / n1, (F.col("s_all") - F.col("s")) / n0
    v1 = F.greatest((F.col("ss") - F.col("s") * m1) / (n1 - 1), F.lit(0.0))
    s0, ss0 = F.col("s_all") - F.col("s"), F.col("ss_all") - F.col("ss")
    v0 = F.greatest((ss0 - s0 * m0) / (n0 - 1), F.lit(0.0))
    error = F.sqrt(v1 / n1 + v0 / n0)
    t = F.when(error > 0, (m1 - m0) / error).otherwise(F.lit(0.0))
    return full.filter((n1 > 1) & (n0 > 1)).select(*by, "group", "feature", m1.alias("mean_in"), m0.alias("mean_out"), t.alias("score"))


def ranked_features(scores: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    return top_per_group(scores, [*by, "group"], [F.desc("score"), F.asc("feature")], n)


def split_feature_set(scores: DataFrame, n_cells: int, by: list[str] = ()) -> DataFrame:
    """Union of the two sides' top lists: 200 per side for medium nodes, else 1000."""
    n = 200 if 500 < n_cells < 5000 else 1000
    return ranked_features(scores, n, by).select(*by, "feature").distinct()


def common_split_features(long: DataFrame, sets: DataFrame, batch: str = "batch") -> DataFrame:
    """Features of any batch's set that every batch measures."""
    from markertree.operators.select import shared_features

    return sets.select("feature").distinct().join(shared_features(long, batch), "feature", "left_semi")


def variable_features(long: DataFrame, cells: DataFrame, by: list[str] = (), bins: int = 20,
                      top: int | None = None, min_disp: float | None = 0.5) -> DataFrame:
    """Dispersion (variance over mean, of expm1 values) normalised within equal-width mean bins.

    ``cells`` has one row per cell, so implicit zeros count. Bins with a single feature
    get a normalised dispersion of 1. Selects by rank (``top``) or by ``min_disp``.
    """
    by = list(by)
    size = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    raw = F.expm1("value")
    sums = long.groupBy(*by, "feature").agg(F.sum(raw).alias("_s"), F.sum(raw * raw).alias("_ss"))
    joined = sums.join(size, by) if by else attach_row(sums, size)
    mean = F.col("_s") / F.col("_n")
    var = (F.col("_ss") - F.col("_s") * mean) / (F.col("_n") - 1)
    stats = joined.select(*by, "feature", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var")).filter("mean > 0 and var > 0")
    logged = stats.withColumn("log_mean", F.log1p("mean")).withColumn("log_disp", F.log(F.col("var") / F.col("mean")))
    ends = logged.groupBy(*by).agg(F.min("log_mean").alias("_lo"), F.max("log_mean").alias("_hi"))
    ranged = logged.join(ends, by) if by else attach_row(logged, ends)
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("log_mean") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = ranged.withColumn("bin", bin_.cast("int"))
    per = binned.groupBy(*by, "bin").agg(F.avg("log_disp").alias("_bm"), F.stddev_samp("log_disp").alias("_bs"))
    norm = F.when(F.col("_bs").isNull() | (F.col("_bs") == 0), F.lit(1.0)).otherwise((F.col("log_disp") - F.col("_bm")) / F.col("_bs"))
    out = binned.join(per, [*by, "bin"]).withColumn("dispersion", norm).select(*by, "feature", "mean", "bin", "dispersion")
    if top is not None:
        if by:
            return top_per_group(out, by, [F.desc("dispersion"), F.asc("feature")], top)
        return out.orderBy(F.desc("dispersion"), "feature").limit(top)
    return out.filter(F.col("dispersion") > min_disp)


def variable_across_batches(per_batch: DataFrame, n_batches: int, top: int) -> DataFrame:
    """Combine per-batch selections: chosen in most batches first, then by mean dispersion."""
    votes = per_batch.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_chosen"), (F.sum("dispersion") / F.lit(float(n_batches))).alias("dispersion"))
    return votes.orderBy(F.desc("n_chosen"), F.desc("dispersion"), "feature").limit(top)


def rank_batches(df: DataFrame, batch: str, components: list[str], keep: int = 8) -> DataFrame:
    """Batches by the variance of leading components plus a size term (B * share of cells)."""
    per = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), sum(F.var_samp(c) for c in components).alias("v"))
    total = per.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_b"))
    score = attach_row(per, total).withColumn("score", F.col("v") + F.col("_b") * F.col("n") / F.col("_all"))
    ranked = score.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(batch))))
    return ranked.filter(F.col("rank") <= keep).select(batch, "n", "score", "rank")


def informative_components(fits: DataFrame) -> DataFrame:
    """First component whose one-Gaussian BIC beats the two-Gaussian BIC, plus one. Input (pc, k, bic)."""
    wide = fits.groupBy("pc").agg(
        F.max(F.when(F.col("k") == 1, F.col("bic"))).alias("b1"), F.max(F.when(F.col("k") == 2, F.col("bic"))).alias("b2"))
    return wide.agg((F.coalesce(F.min(F.when(F.col("b1") < F.col("b2"), F.col("pc"))), F.max("pc")) + 1).alias("n_components"))


def loading_and_score_features(loadings: DataFrame, scores: DataFrame, long: DataFrame, n_loading: int = 50,
                               n_score: int = 50, batch: str = "batch") -> DataFrame:
    """Extreme loadings and top differential features of each batch, kept when every batch measures them."""
    extreme = extreme_features(loadings, [batch], "w", n_loading).select(batch, "feature")
    top = ranked_features(scores, n_score, [batch]).select(batch, "feature")
    return common_split_features(long, extreme.union(top).distinct(), batch)
