"""Log-likelihood gain of a given cut for every marker and batch, from moments alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.functions.stats import gauss_ll_1d
from markertree.operators.normalize import clr_by_feature


def marker_gains(long: DataFrame, cut: float = 0.0, min_side: int = 100) -> DataFrame:
    """CLR, split every marker at ``cut``, gain = weighted side log-likelihoods minus the whole's, ranked per batch.

    One aggregate gives the moments of both sides and of the whole; the ranking window sees one row per marker.
    """
    hi = F.col("value") > cut
    m = clr_by_feature(long).groupBy("batch", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hi).alias("n1"), F.count_if(~hi).alias("n0"),
        F.var_pop("value").alias("v"),
        F.var_pop(F.when(hi, F.col("value"))).alias("v1"), F.var_pop(F.when(~hi, F.col("value"))).alias("v0"),
    )
    gain = gauss_ll_1d("v1") * F.col("n1") / F.col("n") + gauss_ll_1d("v0") * F.col("n0") / F.col("n") - gauss_ll_1d("v")
    small = (F.col("n0") < min_side) | (F.col("n1") < min_side)
    scored = m.withColumn("gain", F.when(small, F.lit(-1000.0)).otherwise(gain))
    order = Window.partitionBy("batch").orderBy(F.desc("gain"), F.asc("feature"))
    return scored.withColumn("rank", F.row_number().over(order)).select("batch", "feature", "n0", "n1", "gain", "rank")
