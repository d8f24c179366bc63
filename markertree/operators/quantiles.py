"""Exact interpolated quantiles per group without holding a group in one task.

Values are counted into equal-width bins with map-side combine; only the bins that hold
a wanted rank are refined, and within them equal values are counted together, so a value
that fills a third of the table costs one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import sized


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], bins: int = 4096) -> DataFrame:
    """One row per group with columns ``q0, q1, …`` for ``probs`` (linear interpolation)."""
    by = list(by)
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not by:
        data, by_ = data.withColumn("_all", F.lit(0)), ["_all"]
    else:
        by_ = by
    limits = sized(data.groupBy(*by_).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = data.join(limits, by_).select(*by_, "_v", "_n", bin_.cast("int").alias("_bin"))
    counts = binned.groupBy(*by_, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*by_).orderBy("_bin")
    ranked = counts.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    # zero-based ranks needed: floor and ceiling of p * (n - 1) for each probability
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))) for p in probs
    ])))
    hit = ranked.withColumn(
        "_ranks", F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    ).filter(F.size("_ranks") > 0)
    hit = sized(hit.select(*by_, "_bin", "_before", "_ranks"))
    inside = binned.drop("_n").join(hit, [*by_, "_bin"])
    distinct = inside.groupBy(*by_, "_bin", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks")
    )
    within = Window.partitionBy(*by_, "_bin").orderBy("_v")
    start = F.col("_before") + F.sum("_c").over(within) - F.col("_c")
    picks = distinct.withColumn("_start", start).select(
        *by_, "_v",
        F.explode(F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))).alias("_rank"),
    )
    lookup = picks.groupBy(*by_).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    out = lookup.join(limits, by_)
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return out.select(*by, *cols)
