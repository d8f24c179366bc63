"""Projection on stored directions, Gaussian posteriors, cuts, and assignment to leaf Gaussians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.functions.stats import (
    LN_2PI, RIDGE, bivariate_normal_logpdf, normal_logpdf, posterior_two,
)
from markertree.session import attach_row, bounded_rows, sized


def project(long: DataFrame, weights: DataFrame, cell: list[str] = ("batch", "cell_id"),
            by: list[str] = ()) -> DataFrame:
    """h = sum over features of value * weight, per cell (and per node or batch in ``by``).

    Absent entries are zeros, so the long table needs none. The weight table is broadcast when its
    measured size allows.
    """
    return (
        long.join(sized(weights), ["feature", *[k for k in by if k in long.columns]])
        .groupBy(*dict.fromkeys([*cell, *by]))
        .agg(F.sum(F.col("value") * F.col("w")).alias("h"))
    )


def two_cut_sides(h: DataFrame, m0: float | None = None, m1: float | None = None, cutoff: float = 0.1,
                  cuts: tuple[float, float] | None = None) -> DataFrame:
    """L below the lower cut, R above the upper cut, null in between (and on a cut).

    The cuts sit around the middle of the two class means; ``cuts`` overrides them.
    """
    low, high = cuts if cuts else projection_cuts(m0, m1, cutoff)
    return h.withColumn("side", F.when(F.col("h") < low, "L").when(F.col("h") > high, "R"))


def projection_cuts(m0: float, m1: float, cutoff: float) -> tuple[float, float]:
    low, high = min(m0, m1), max(m0, m1)
    half_band = (high - low) / 2.0 * (1.0 - cutoff) * 0.01
    middle = (low + high) / 2.0
    return middle - half_band, middle + half_band


def side_posterior(cells: DataFrame, side: str, markers: list[str], by: list[str] = (),
                   chain: str | None = None, keep_above: float | None = None) -> DataFrame:
    """Posterior of each cell's own side under the two side Gaussians (one or two markers).

    ``chain`` names a column with the parent's posterior; the product is the path probability.
    ``keep_above`` keeps only confident cells.
    """
    if len(markers) not in (1, 2):
        raise ValueError("one or two markers")
    labelled = cells.filter(F.col(side).isin("L", "R"))
    aggs = []
    for s in ("L", "R"):
        pick = lambda m, s=s: F.when(F.col(side) == s, F.col(m))
        aggs.append(F.count_if(F.col(side) == s).alias(f"_n{s}"))
        for i, m in enumerate(markers):
            aggs += [F.avg(pick(m)).alias(f"_m{s}{i}"), F.var_samp(pick(m)).alias(f"_v{s}{i}")]
        if len(markers) == 2:
            aggs.append(F.covar_samp(pick(markers[0]), pick(markers[1])).alias(f"_c{s}"))
    stats = sized(labelled.groupBy(*by).agg(*aggs))
    joined = labelled.join(stats, list(by)) if by else attach_row(labelled, stats)

    def density(s: str) -> Column:
        if len(markers) == 1:
            return normal_logpdf(markers[0], f"_m{s}0", f"_v{s}0")
        return bivariate_normal_logpdf(
            markers[0], markers[1], f"_m{s}0", f"_m{s}1", f"_v{s}0", f"_v{s}1", f"_c{s}"
        )

    share = F.col("_nL") / (F.col("_nL") + F.col("_nR"))
    left = posterior_two(density("L"), density("R"), share)
    out = joined.withColumn("posterior", F.when(F.col(side) == "L", left).otherwise(F.lit(1.0) - left))
    if chain:
        out = out.withColumn("path_posterior", F.col("posterior") * F.col(chain))
    if keep_above is not None:
        out = out.filter(F.col("path_posterior" if chain else "posterior") > keep_above)
    return out.drop(*[f"_{x}" for x in _stat_names(len(markers))])


def _stat_names(d: int) -> list[str]:
    names = []
    for s in ("L", "R"):
        names.append(f"n{s}")
        for i in range(d):
            names += [f"m{s}{i}", f"v{s}{i}"]
        if d == 2:
            names.append(f"c{s}")
    return names


def leaf_gaussians(assigned: DataFrame, leaf: str, markers: list[str]) -> list[dict]:
    """Mean, covariance and weight per leaf; leaf-sized, so it may live on the driver."""
    from markertree.operators.moments import moments

    rows = bounded_rows(moments(assigned, [leaf], markers))
    total = sum(r["n"] for r in rows)
    out = []
    for row in sorted(rows, key=lambda r: str(r[leaf])):
        cov = [[0.0] * len(markers) for _ in markers]
        for i, a in enumerate(markers):
            cov[i][i] = row[f"var_{a}"] or 0.0
            for j in range(i + 1, len(markers)):
                cov[i][j] = cov[j][i] = row[f"cov_{a}_{markers[j]}"] or 0.0
        out.append({"leaf": row[leaf], "weight": row["n"] / total, "mean": [row[f"mean_{m}"] for m in markers], "cov": cov})
    return out


def gaussian_logpdf(markers: list[str], mean: list[float], cov: list[list[float]]) -> Column:
    """Multivariate normal log-density as a plain expression; singular directions are ignored.

    The inverse square root is factorised once on the driver, so each row costs d*(d+1)/2 products.
    """
    import numpy as np

    values, vectors = np.linalg.eigh(np.asarray(cov, dtype=float))
    keep = values > max(values.max(), 0.0) * 1e-10 if values.size else values > 0
    values, vectors = values[keep], vectors[:, keep]
    constant = -0.5 * (len(values) * LN_2PI + float(np.log(values).sum()))
    total: Column = F.lit(constant)
    for value, vector in zip(values, vectors.T):
        along = None
        for m, v, mu in zip(markers, vector, mean):
            term = (F.col(m) - F.lit(float(mu))) * F.lit(float(v))
            along = term if along is None else along + term
        total = total - along * along * F.lit(0.5 / float(value))
    return total


def assign_to_leaves(cells: DataFrame, leaves: list[dict], markers: list[str], confidence: float = 0.0,
                     compat_logratio: bool = False) -> DataFrame:
    """Label each cell with its most probable leaf Gaussian; null below the confidence bar.

    Probabilities are a softmax of log density + log weight, and the bar is ``2*confidence/L``.
    ``compat_logratio`` instead divides the log scores by their sum and takes the smallest share,
    as older result files did. The leaf list is node-sized; the table is scanned once, without a join.
    """
    total = sum(leaf["weight"] for leaf in leaves)
    scores = [
        gaussian_logpdf(markers, leaf["mean"], leaf["cov"]) + F.log(F.lit(leaf["weight"] / total)) for leaf in leaves
    ]
    names = F.array(*[F.lit(str(leaf["leaf"])) for leaf in leaves])
    out = cells.withColumn("_s", F.array(*scores))
    if compat_logratio:
        shares = F.transform("_s", lambda s: s / F.aggregate("_s", F.lit(0.0), lambda a, v: a + v))
        out = out.withColumn("_s", shares)
        best = F.array_min("_s")
        ok = best < F.lit((1.0 - confidence) / len(leaves) * 2.0)
        probability = best
    else:
        best = F.array_max("_s")
        probability = F.lit(1.0) / F.aggregate("_s", F.lit(0.0), lambda a, v: a + F.exp(v - best))
        ok = probability > F.lit(confidence / len(leaves) * 2.0)
    index = F.array_position("_s", best).cast("int")
    return (
        out.withColumn("leaf_label", F.when(ok, F.element_at(names, index)))
        .withColumn("leaf_probability", probability)
        .drop("_s")
    )


def mixture_posteriors(x: str, components: list[tuple[float, float, float]]) -> list[Column]:
    """Posterior columns of a 1-D mixture given as (weight, mean, variance)."""
    logs = [F.log(F.lit(w)) + normal_logpdf(x, float(m), float(v)) for w, m, v in components]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(v - top) for v in logs]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights]


def merged_label(x: str, components: list[tuple[float, float, float]], merged_to: list[int]) -> Column:
    """Hard label of a merged mixture: the label whose summed posterior is largest, lowest index on ties."""
    post = mixture_posteriors(x, components)
    sums = []
    for label in range(max(merged_to) + 1):
        parts = [p for p, m in zip(post, merged_to) if m == label]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        sums.append(total)
    array = F.array(*sums)
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def single_gaussian_scores(df: DataFrame, by: list[str], markers: list[str], ridge: float = RIDGE) -> DataFrame:
    """Mean log-likelihood and BIC of one Gaussian per group, from population moments."""
    from markertree.functions.stats import gauss_ll_1d, gauss_ll_2d, gmm_bic
    from markertree.operators.moments import moments

    m = moments(df, by, markers, ddof=0)
    a = markers[0]
    ll = gauss_ll_1d(f"var_{a}", ridge) if len(markers) == 1 else gauss_ll_2d(
        f"var_{a}", f"var_{markers[1]}", f"cov_{a}_{markers[1]}", ridge)
    return m.withColumn("ll", ll).withColumn("bic", gmm_bic("ll", "n", F.lit(1.0), F.lit(float(len(markers)))))


def projection_overlap(h: DataFrame, side: str, n_large: int = 10_000, by: list[str] = ()) -> DataFrame:
    """Overlap e^(-D) of the two sides of a 1-D score against a size-dependent bar, plus spread ratios; per group ``by``."""
    from markertree.functions.stats import bhattacharyya

    s = lambda fn, k: fn(F.when(F.col(side) == k, F.col("h")))
    stats = h.filter(F.col(side).isin("L", "R")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        s(F.avg, "L").alias("m0"), s(F.avg, "R").alias("m1"),
        s(F.var_samp, "L").alias("v0"), s(F.var_samp, "R").alias("v1"),
    )
    square = lambda c: F.col(c) * F.col(c)
    bar = F.when(F.col("n") > n_large, 0.02).otherwise(0.05 * (2.0 - F.col("n") / 10_000.0))
    return stats.select(
        *by, "n", "m0", "m1",
        F.exp(-bhattacharyya("m0", "v0", "m1", "v1")).alias("overlap"), bar.alias("bar"),
        (F.col("v0") / square("m0") + F.col("v1") / square("m1")).alias("within"),
        ((F.col("m1") - F.col("m0")) * (F.col("m1") - F.col("m0")) / ((square("m0") + square("m1")) / 2.0)).alias("between"),
    ).withColumn("separable", F.col("overlap") < F.col("bar"))


