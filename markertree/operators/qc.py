"""Quality control: detection filters, per-cell metrics, outlier fences, density filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.functions.stats import bivariate_normal_logpdf, normal_logpdf
from markertree.operators.quantiles import exact_quantiles
from markertree.session import lookup, sized


def cells_with_features(long: DataFrame, min_features: int, cell: list[str] = ("cell_id",)) -> DataFrame:
    """A cell has at most one row per feature, so counting in a window costs one shuffle and no join."""
    detected = F.count_if(F.col("value") > 0).over(Window.partitionBy(*cell))
    return long.withColumn("_n", detected).filter(F.col("_n") >= min_features).drop("_n")


def features_in_cells(long: DataFrame, min_cells: int, by: list[str] = ()) -> DataFrame:
    keys = [*by, "feature"]
    keep = long.groupBy(*keys).agg(F.count_if(F.col("value") > 0).alias("_n")).filter(F.col("_n") >= min_cells)
    return long.join(lookup(keep.select(*keys)), keys, "left_semi")


def flag_by_prefix(features: DataFrame, prefix: str, flag: str = "flagged") -> DataFrame:
    return features.withColumn(flag, F.col("feature").startswith(prefix))


def cell_metrics(long: DataFrame, flagged, cell: list[str] = ("cell_id",)) -> DataFrame:
    """Per cell: detected features, total, total and percentage of the flagged features."""
    out = long.groupBy(*cell).agg(
        F.count_if(F.col("value") > 0).alias("n_features"),
        F.sum("value").alias("total"),
        F.sum(F.when(flagged, F.col("value")).otherwise(F.lit(0.0))).alias("total_flagged"),
    )
    return out.withColumn(
        "pct_flagged",
        F.when(F.col("total") > 0, F.lit(100.0) * F.col("total_flagged") / F.col("total")).otherwise(F.lit(0.0)),
    )


def healthy_cells(metrics: DataFrame, max_features: int = 3000, max_pct: float = 10.0) -> DataFrame:
    return metrics.filter((F.col("n_features") < max_features) & (F.col("pct_flagged") < max_pct))


def varying_features(long: DataFrame, by: list[str] = ()) -> DataFrame:
    """Drop features without variance."""
    keys = [*by, "feature"]
    keep = long.groupBy(*keys).agg((F.max("value") > F.min("value")).alias("_v")).filter("_v")
    return long.join(sized(keep.select(*keys)), keys, "left_semi")


def distinct_counts(long: DataFrame, by: list[str] = ()) -> DataFrame:
    """Exact distinct values per feature; equal values meet map-side before the shuffle."""
    keys = [*by, "feature"]
    return long.select(*keys, "value").distinct().groupBy(*keys).agg(F.count("value").alias("n_unique"))


def iqr_outliers(wide: DataFrame, id_column: str, columns: list[str], factor: float = 3.0,
                 max_drop: int | None = 30, min_left: int | None = 50) -> dict:
    """Fences Q1 - c*IQR and Q3 + c*IQR, on columns whose range is at least 3*c*IQR.

    Columns are taken in order. When the fences so far would drop more than ``max_drop`` cells
    (or leave fewer than ``min_left``), only the lowest and the highest cell of the current column
    go instead and the walk stops; ``min_left=None`` keeps the fences at that point. The table is
    flagged when a range exceeds 5*c*IQR. Only per-column scalars reach the driver.
    """
    long = wide.select(id_column, *columns).unpivot([id_column], columns, "feature", "value")
    fences = exact_quantiles(long, ["feature"], "value", [0.25, 0.75])
    ends = long.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min(F.struct("value", id_column))[id_column].alias("lo_id"),
        F.min(F.struct((-F.col("value")).alias("v"), F.col(id_column)))[id_column].alias("hi_id"),
    )
    stat = {r["feature"]: r for r in fences.join(ends, "feature").collect()}
    fenced, tests, flagged = [], [], False
    for name in columns:
        s = stat[name]
        reach = factor * (s["q1"] - s["q0"])
        spread = s["hi"] - s["lo"]
        flagged = flagged or spread > 5.0 * reach
        if spread < 3.0 * reach:
            continue
        c = F.col(name)
        test = (c > s["q0"] - reach) & (c < s["q1"] + reach)
        tests.append(test if not tests else tests[-1] & test)
        fenced.append(name)
    if not tests:
        return {"cells": wide, "flagged": flagged}
    counts = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"k{i}") for i, t in enumerate(tests)]).first()
    for i, name in enumerate(fenced):
        left = counts[f"k{i}"]
        too_many = max_drop is not None and counts["n"] - left > max_drop
        too_few = min_left is not None and left < min_left
        if too_many and min_left is None:
            return {"cells": wide.filter(tests[i]), "flagged": flagged}
        if too_many or too_few:
            ends_ids = [stat[name]["lo_id"], stat[name]["hi_id"]]
            return {"cells": wide.filter(~F.col(id_column).isin(ends_ids)), "flagged": flagged}
    return {"cells": wide.filter(tests[-1]), "flagged": flagged}


def dense_core(cells: DataFrame, leaf: str, markers: list[str], quantile: float = 0.25) -> DataFrame:
    """Keep the cells of each leaf whose Gaussian density lies above the leaf's lower quantile."""
    if len(markers) not in (1, 2):
        raise ValueError("one or two markers")
    a = markers[0]
    aggs = [F.avg(a).alias("_ma"), F.var_samp(a).alias("_va")]
    if len(markers) == 2:
        b = markers[1]
        aggs += [F.avg(b).alias("_mb"), F.var_samp(b).alias("_vb"), F.covar_samp(a, b).alias("_cab")]
    stats = sized(cells.groupBy(leaf).agg(*aggs))
    density = (
        normal_logpdf(a, "_ma", "_va") if len(markers) == 1
        else bivariate_normal_logpdf(a, b, "_ma", "_mb", "_va", "_vb", "_cab")
    )
    scored = cells.join(stats, leaf).withColumn("log_density", density).select(*cells.columns, "log_density")
    floor = sized(exact_quantiles(scored, [leaf], "log_density", [quantile]).withColumnRenamed("q0", "_floor"))
    return scored.join(floor, leaf).filter(F.col("log_density") > F.col("_floor")).drop("_floor")


def spread_guard(sides: DataFrame, markers: list[str], group: list[str]) -> DataFrame:
    """Overly discrete partitions: the smallest range over the key markers is below ln 5 (1-D) or ln 3 (2-D)."""
    limit = math.log(5.0) if len(markers) == 1 else math.log(3.0)
    ranges = [F.max(m) - F.min(m) for m in markers]
    least = ranges[0] if len(ranges) == 1 else F.least(*ranges)
    return sides.groupBy(*group).agg(least.alias("min_range")).withColumn("too_discrete", F.col("min_range") < limit)


def sanity_report(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("positive_share"),
    )
