"""Normalisation. Per-feature statistics are aggregated (with map-side combine) and joined
back, never computed in a window over a feature: one feature may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import attach_row, lookup, sized

from markertree.functions.stats import array_norm, hashed_normal


def clr_by_feature(long: DataFrame, by: list[str] = ("batch",)) -> DataFrame:
    """ln(x+1) minus the mean of ln(x+1) over the cells of each feature (and batch)."""
    keys = [*by, "feature"]
    logged = long.withColumn("value", F.log1p("value"))
    centre = sized(logged.groupBy(*keys).agg(F.avg("value").alias("_centre")))
    return logged.join(centre, keys).withColumn("value", F.col("value") - F.col("_centre")).drop("_centre")


def clr_by_cell(long: DataFrame, cell: list[str] = ("cell_id",)) -> DataFrame:
    """The same, centred per cell. A cell has at most one row per feature, so a window (one shuffle) is safe."""
    logged = F.log1p("value")
    return long.withColumn("value", logged - F.avg(logged).over(Window.partitionBy(*cell)))


def clr_wide(cells: DataFrame, markers: list[str], by: list[str] | None = None) -> DataFrame:
    """CLR of a wide marker table: one small aggregate, one pass, no row explosion."""
    by = list(by or [])
    centre = cells.groupBy(*by).agg(*[F.avg(F.log1p(f"`{m}`")).alias(f"_c_{m}") for m in markers])
    centre = sized(centre) if by else centre
    joined = cells.join(centre, by) if by else attach_row(cells, centre)
    keep = [c for c in cells.columns if c not in markers]
    return joined.select(*keep, *[(F.log1p(f"`{m}`") - F.col(f"_c_{m}")).alias(m) for m in markers])


def depth_normalize(long: DataFrame, cell: list[str] = ("cell_id",), target: float = 1e4) -> DataFrame:
    """x * target / total of the cell; one shuffle, since a cell has at most one row per feature."""
    total = F.sum("value").over(Window.partitionBy(*cell))
    return long.withColumn("_total", total).withColumn(
        "value", F.when(F.col("_total") != 0, F.col("value") * F.lit(target) / F.col("_total")).otherwise(F.lit(0.0))
    ).drop("_total")


def scale_to_depth(long: DataFrame, cell: list[str] = ("cell_id",), target: float = 1e4) -> DataFrame:
    """``depth_normalize`` for a stored table: the totals, one row a cell, are stored and joined back, so entries need not move."""
    totals = lookup(long.groupBy(*cell).agg(F.sum("value").alias("_total")))
    return long.join(totals, list(cell)).withColumn(
        "value", F.when(F.col("_total") != 0, F.col("value") * F.lit(target) / F.col("_total")).otherwise(F.lit(0.0))
    ).drop("_total")


def log_transform(long: DataFrame, kind: str = "log1p") -> DataFrame:
    fn = {"log1p": F.log1p, "expm1": F.expm1, "exp": F.exp, "log2": F.log2}[kind]
    return long.withColumn("value", fn("value"))


def wide_markers(long: DataFrame, markers: list[str], by: list[str] = ("batch", "cell_id")) -> DataFrame:
    """One row per cell, one column per marker. A single aggregate: rows of a cell that lie together shuffle as one."""
    at = lambda m: F.first(F.when(F.col("feature") == m, F.col("value")), ignorenulls=True)
    return long.groupBy(*by).agg(*[at(m).alias(m) for m in markers])


def zscore(long: DataFrame, by: list[str] = (), clip: float | None = 10.0, centre: bool = True) -> DataFrame:
    """Per-feature z-score with the sample deviation, optional clipping.

    Expects all values present (dense features); sparse tables use the Gram algebra instead.
    """
    keys = [*by, "feature"]
    stats = sized(long.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")))
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    z = ((F.col("value") - F.col("_m")) if centre else F.col("value")) / sd
    if clip is not None:
        z = F.least(z, F.lit(float(clip)))
        if centre:
            z = F.greatest(z, F.lit(-float(clip)))
    return long.join(stats, keys).withColumn("value", z).drop("_m", "_s")


def round_counts(long: DataFrame) -> DataFrame:
    """Round half to even."""
    return long.withColumn("value", F.bround("value", 0))


def l2_normalize(df: DataFrame, array: str) -> DataFrame:
    norm = array_norm(array)
    return df.withColumn("_norm", norm).withColumn(
        array, F.transform(array, lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v.cast("double")))
    ).drop("_norm")


def standardize_weights(weights: DataFrame, node: str = "node_id") -> DataFrame:
    """Standardise each node's weight vector with the population deviation."""
    stats = weights.groupBy(node).agg(F.avg("w").alias("_m"), F.stddev_pop("w").alias("_s"))
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    return weights.join(stats, node).withColumn("w", (F.col("w") - F.col("_m")) / sd).drop("_m", "_s")


def depth_scaled_weights(weights: DataFrame, node: str = "node_id") -> DataFrame:
    """w * (log2(2i+1) + 1) / 10 for node index i."""
    return weights.withColumn("w", F.col("w") * (F.log2(F.col(node) * 2 + 1) + F.lit(1.0)) / F.lit(10.0))


def jitter(long: DataFrame, scale: float = 0.01, seed: int = 0, keys: list[str] = ("cell_id", "feature"),
           on_log: bool = False) -> DataFrame:
    """Break ties with small noise that is a function of the keys, so reruns agree."""
    noise = hashed_normal(seed, *keys) * F.lit(scale)
    if on_log:
        shifted = F.expm1("value") + noise
        return long.withColumn("value", F.log1p(F.greatest(shifted, F.lit(-1.0 + 1e-9))))
    return long.withColumn("value", F.col("value") + noise)


def smooth(long: DataFrame, by: list[str] = ("batch",), seed: int = 0, scale: float = 0.01) -> DataFrame:
    """Centre-log-ratio first for features whose values are all >= 0, then jitter."""
    keys = [*by, "feature"]
    lows = sized(long.groupBy(*keys).agg(
        (F.min("value") >= 0).alias("_counts"), F.avg(F.when(F.col("value") > -1, F.log1p("value"))).alias("_centre")
    ))
    out = long.join(lows, keys).withColumn(
        "value", F.when(F.col("_counts"), F.log1p("value") - F.col("_centre")).otherwise(F.col("value"))
    ).drop("_counts", "_centre")
    return jitter(out, scale, seed)
