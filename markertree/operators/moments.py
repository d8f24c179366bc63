"""Group moments in one pass with partial aggregation: the input of every closed form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markertree.session import attach_row, sized


def moment_aggregates(cols: list[str], ddof: int = 1) -> list:
    var = F.var_samp if ddof else F.var_pop
    cov = F.covar_samp if ddof else F.covar_pop
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.avg(c).alias(f"mean_{c}") for c in cols]
    out += [var(c).alias(f"var_{c}") for c in cols]
    out += [cov(a, b).alias(f"cov_{a}_{b}") for a, b in combinations(cols, 2)]
    return out


def moments(df: DataFrame, by: list[str], cols: list[str], ddof: int = 1) -> DataFrame:
    """n, means, variances and covariances per group (sample or population)."""
    return df.groupBy(*by).agg(*moment_aggregates(cols, ddof))


def weighted_moments(df: DataFrame, by: list[str], cols: list[str], weight: str) -> DataFrame:
    """Weighted means and biased covariances, two passes for stability: centres first, then spread."""
    centres = df.groupBy(*by).agg(
        F.sum(weight).alias("weight"),
        *[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"mean_{c}") for c in cols],
    )
    centres = sized(centres)
    joined = df.join(centres, list(by)) if by else attach_row(df, centres)
    centred = joined.select(
        *by, F.col(weight).alias("_w"), *[(F.col(c) - F.col(f"mean_{c}")).alias(f"_d_{c}") for c in cols]
    )
    spread = centred.groupBy(*by).agg(
        *[
            (F.sum(F.col("_w") * F.col(f"_d_{a}") * F.col(f"_d_{b}")) / F.sum("_w")).alias(
                f"var_{a}" if a == b else f"cov_{a}_{b}"
            )
            for i, a in enumerate(cols) for b in cols[i:]
        ]
    )
    return centres.join(spread, list(by)) if by else attach_row(centres, spread)


def frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Value counts, most frequent first; ``top`` is the report length."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), F.asc(column)).limit(top)


def conditional_means(df: DataFrame, value: str, condition, threshold: float) -> DataFrame:
    """Mean of a value where a condition holds and where not, and the share above a threshold."""
    v = F.col(value)
    above = F.when(v > threshold, 1.0).otherwise(0.0)
    return df.agg(
        F.avg(F.when(condition, v)).alias("mean_true"),
        F.avg(F.when(~condition, v)).alias("mean_false"),
        F.avg(F.when(condition, above)).alias("share_above_true"),
        F.avg(F.when(~condition, above)).alias("share_above_false"),
    )


def correlations(df: DataFrame, by: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def histogram(df: DataFrame, by: list[str], value: str, lo, hi, bins: int) -> DataFrame:
    """Density histogram: equal-width bins between given limits, the last bin closed."""
    lo, hi = F.lit(lo) if not hasattr(lo, "cast") else lo, F.lit(hi) if not hasattr(hi, "cast") else hi
    width = (hi - lo) / F.lit(float(bins))
    binned = df.filter((F.col(value) >= lo) & (F.col(value) <= hi)).select(
        *by, F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"),
        width.alias("_width"),
    )
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("_width").alias("_width"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total")) if by else counts.agg(F.sum("n").alias("_total"))
    joined = counts.join(totals, list(by)) if by else attach_row(counts, totals)
    return joined.withColumn("density", F.col("n") / F.col("_total") / F.col("_width")).drop("_total", "_width")


def feature_histogram(long: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Histogram of every feature of a long table between the feature's own minimum and maximum."""
    limits = sized(long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    joined = long.join(limits, "feature").filter(F.col("_hi") > F.col("_lo"))
    return histogram(joined, [*by, "feature"], "value", F.col("_lo"), F.col("_hi"), bins)


def leaf_summary(assigned: DataFrame, leaf: str, markers: list[str]) -> DataFrame:
    """Count, proportion and marker means per leaf."""
    per = assigned.groupBy(leaf).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in markers])
    total = per.agg(F.sum("n").alias("_total"))
    return attach_row(per, total).withColumn("proportion", F.col("n") / F.col("_total")).drop("_total")
