"""Candidate scan: all markers (then near-separable marker pairs) of all open groups in one job.

One pass counts values into bins per (group, marker) with map-side combine, so the shuffle carries bins, not
cells, and a group holding a third of the table costs no more than a small one. Each candidate's
bins then meet in one small task where mixtures are fitted, merged and scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markertree.operators import knots as K
from markertree.operators.profiles import Profile
from markertree.session import BROADCAST_ROW_LIMIT

BINS_1D = 2048
BINS_2D = 64

RECORD = [
    T.StructField("key", T.ArrayType(T.StringType())),
    T.StructField("n", T.LongType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("k_bic", T.IntegerType()),
    T.StructField("k_merged", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("dip", T.DoubleType()),
    T.StructField("filter", T.StringType()),
    T.StructField("separable", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("covs", T.ArrayType(T.DoubleType())),
    T.StructField("merged", T.ArrayType(T.IntegerType())),
    T.StructField("chosen", T.IntegerType()),
    T.StructField("n_chosen", T.LongType()),
    T.StructField("mean_chosen", T.ArrayType(T.DoubleType())),
    T.StructField("mean_rest", T.ArrayType(T.DoubleType())),
    T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
]


def group_limits(df: DataFrame, group: list[str], markers: list[str]) -> DataFrame:
    """Long (group, feature, n, lo, hi): one aggregate row per group, unpivoted after the aggregate."""
    stats = df.groupBy(*group).agg(
        *[F.struct(F.count(m).alias("n"), F.min(m).alias("lo"), F.max(m).alias("hi")).alias(f"_s_{i}") for i, m in enumerate(markers)]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("feature"), F.col(f"_s_{i}.n").alias("n"), F.col(f"_s_{i}.lo").alias("lo"), F.col(f"_s_{i}.hi").alias("hi"))
        for i, m in enumerate(markers)
    ])).alias("_r")
    return stats.select(*group, rows).select(*group, "_r.*").filter("n > 0")


def marker_knots(df: DataFrame, group: list[str], markers: list[str], limits: DataFrame, bins: int = BINS_1D) -> DataFrame:
    """Bins per (group, feature): count, sums about the bin middle, range, and the middle itself.

    ``limits`` has one row per group and marker and is broadcast; the caller bounds it.
    """
    long = df.select(*group, *[F.col(m).cast("double").alias(m) for m in markers]).unpivot(group, markers, "feature", "v")
    placed = long.filter(F.col("v").isNotNull()).join(F.broadcast(limits.drop("n")), [*group, "feature"])
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    middle = F.col("lo") + (F.col("bin") + F.lit(0.5)) * width
    binned = placed.withColumn("bin", bin_.cast("int")).withColumn("mid", middle)
    off = F.col("v") - F.col("mid")
    return binned.groupBy(*group, "feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("mid").alias("mid"), F.sum(off).alias("s"), F.sum(off * off).alias("ss"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"),
    )


def _empty(keys, key, n, unique, dip, reason, x=None, scatter=None, weight=None):
    total = float(weight.sum()) if weight is not None and len(weight) else 0.0
    mean = (weight @ x) / total if total else np.zeros(len(key))
    diff = (x - mean) if total else None
    cov = ((weight[:, None] * diff).T @ diff + np.tensordot(weight, scatter, axes=(0, 0))) / total if total else np.zeros((len(key), len(key)))
    return [*keys, list(key), int(n), int(unique), 1, 1, 1.0, float(dip), reason, False, None, 0.0, [1.0],
            [float(v) for v in mean], [float(v) for v in np.ravel(cov)], [0], 0, int(n),
            [float(v) for v in mean], None, None, None]


def _evaluate(keys, key, n, x, scatter, vmin, vmax, unique, p: Profile, cutoff: float, soft: bool):
    """One candidate from gate to score."""
    total = float(n.sum())
    d = x.shape[1]
    dip = 0.0
    if d == 1:
        if soft:
            per, cap, slope, floor = p.soft
            need, bar = min(total / per, cap), max((1 - cutoff) * slope, floor)
        else:
            need = p.fixed_unique - 1 if p.fixed_unique is not None else min(total / p.unique_per_cells, p.unique_cap)
            bar = None if p.dip_slope is None else max((1 - cutoff) * p.dip_slope, p.dip_floor)
        if unique <= need:
            return _empty(keys, key, total, unique, 0.0, "few values", x, scatter, n)
        dip = K.dip_statistic(x[:, 0], n)
        if bar is not None and dip < bar:
            return _empty(keys, key, total, unique, dip, "unimodal", x, scatter, n)
    fits, curve = [], []
    for k in range(1, max(1, min(p.max_k, int(unique), len(x))) + 1):
        fits.append(K.fit_mixture(n, x, scatter, k))
        curve.append(K.bic_of(fits[-1], total))
    k = K.pick_k(curve, p.bic)
    if k == 1 or (p.max_fitted_k is not None and k > p.max_fitted_k) or (
            p.few_k is not None and k > p.few_k and unique < p.few_unique):
        return _empty(keys, key, total, unique, dip, f"components:{k}", x, scatter, n)
    fit = fits[k - 1]
    tail = None
    if p.tail_merge == "always":
        tail = lambda s: s < p.tail_limit
    elif p.tail_merge == "small_n" and total < p.tail_cells:
        tail = lambda s: s < p.tail_limit
    merged, similarity = K.merge_components(fit, cutoff, tail)
    n_merged = max(merged) + 1
    label = K.merged_labels(x, fit.weights, fit.means, fit.covs, merged)
    counts = np.bincount(label, weights=n, minlength=n_merged)
    present = np.flatnonzero(counts > 0)
    shape = [float(v) for v in fit.weights], [float(v) for v in fit.means.ravel()], [float(v) for v in fit.covs.ravel()]
    base = [*keys, list(key), int(total), int(unique), k, n_merged, float(similarity), float(dip), "soft" if soft else "fitted"]
    if n_merged == 1 or len(present) < 2 or counts[present].min() < p.min_cluster:
        return [*base, False, None, 0.0, *shape, merged, 0, int(total), None, None, None, None]
    whole = K.gaussian_ll(n, x, scatter)
    gains, entropies = [], []
    for c in present:
        mine = label == c
        n1, n0 = counts[c], total - counts[c]
        share = n1 / total
        entropies.append(-(share * np.log2(share) + (1 - share) * np.log2(1 - share)))
        if n1 < p.min_side or n0 < p.min_side:
            gains.append(-1000.0)
            continue
        if p.spread_guard:
            spread = min(float((vmax[m].max(axis=0) - vmin[m].min(axis=0)).min()) for m in (mine, ~mine))
            if spread < (np.log(5) if d == 1 else np.log(3)):
                gains.append(-100.0 + spread)
                continue
        part = lambda m: K.gaussian_ll(n[m], x[m], scatter[m])
        gains.append(part(mine) * n1 / total + part(~mine) * n0 / total - whole)
    best = int(np.argmax(entropies if p.name == "entropy" else gains))
    chosen = int(present[best])
    score = entropies[best] if p.name == "entropy" else gains[best]
    if p.name != "entropy":
        score += p.similarity_bonus * (cutoff - similarity)
        if soft or (p.low_similarity is not None and similarity < p.low_similarity):
            score -= 10.0
    mine = label == chosen
    mean = lambda m: [float(v) for v in (n[m] @ x[m]) / n[m].sum()]
    return [*base, True, float(score), float(max(entropies)), *shape, merged, chosen, int(round(counts[chosen])),
            mean(mine), mean(~mine), float(vmin.min()), float(vmax.max())]


def _single_task(group: list[str], p: Profile, cutoff: float, soft: bool, columns: list[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy(dtype=float)
        off = pdf["s"].to_numpy() / n
        x = (pdf["mid"].to_numpy() + off)[:, None]
        lo, hi = pdf["vmin"].to_numpy(), pdf["vmax"].to_numpy()
        single = lo == hi
        x[single, 0] = lo[single]
        scatter = np.maximum(pdf["ss"].to_numpy() / n - off * off, 0.0)
        scatter[single] = 0.0
        # bins with one value count once, wider bins at least twice
        unique = int(np.where(single, 1, 2).sum())
        row = _evaluate(list(key[:-1]), (key[-1],), n, x, scatter[:, None, None], lo[:, None], hi[:, None], unique, p, cutoff, soft)
        return pd.DataFrame([row], columns=columns)

    return run


def _schema(df: DataFrame, group: list[str]) -> T.StructType:
    return T.StructType([df.schema[g] for g in group] + RECORD)


def scan_markers(df: DataFrame, group: list[str], markers: list[str], limits: DataFrame, profile: Profile,
                 cutoff: float | None = None, soft: bool = False, bins: int = BINS_1D) -> DataFrame:
    """One record per (group, marker)."""
    knots = marker_knots(df, group, markers, limits, bins)
    schema = _schema(df, group)
    run = _single_task(group, profile, profile.merge_cutoff if cutoff is None else cutoff, soft, schema.fieldNames())
    return knots.groupBy(*group, "feature").applyInPandas(run, schema)


def pair_knots(df: DataFrame, group: list[str], pairs: DataFrame, limits: DataFrame, bins: int = BINS_2D) -> DataFrame:
    """Grid bins per (group, pair). ``pairs`` (group, a, b) and ``limits`` are node-sized."""
    la, lb = (limits.select(*group, F.col("feature").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
    plan = pairs.join(la, [*group, "a"]).join(lb, [*group, "b"])
    markers = [c for c in df.columns if c not in group]
    packed = df.select(*group, F.create_map(*[x for m in markers for x in (F.lit(m), F.col(m).cast("double"))]).alias("_values"))
    wide = packed.join(F.broadcast(plan), group).withColumn("va", F.col("_values")[F.col("a")]).withColumn("vb", F.col("_values")[F.col("b")])
    wide = wide.filter(F.col("va").isNotNull() & F.col("vb").isNotNull())
    for s in "ab":
        width = (F.col(f"hi_{s}") - F.col(f"lo_{s}")) / F.lit(float(bins))
        bin_ = F.when(width > 0, F.least(F.floor((F.col(f"v{s}") - F.col(f"lo_{s}")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
        wide = wide.withColumn(f"bin_{s}", bin_.cast("int")).withColumn(f"mid_{s}", F.col(f"lo_{s}") + (F.col(f"bin_{s}") + 0.5) * width)
    da, db = F.col("va") - F.col("mid_a"), F.col("vb") - F.col("mid_b")
    return wide.groupBy(*group, "a", "b", "bin_a", "bin_b").agg(
        F.count(F.lit(1)).alias("n"), F.max("mid_a").alias("mid_a"), F.max("mid_b").alias("mid_b"),
        F.sum(da).alias("sa"), F.sum(db).alias("sb"), F.sum(da * da).alias("saa"), F.sum(db * db).alias("sbb"), F.sum(da * db).alias("sab"),
        F.min("va").alias("amin"), F.max("va").alias("amax"), F.min("vb").alias("bmin"), F.max("vb").alias("bmax"),
    )


def _pair_task(p: Profile, cutoff: float, columns: list[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin_a", "bin_b"])
        col = lambda c: pdf[c].to_numpy(dtype=float)
        n = col("n")
        off = np.column_stack([col("sa") / n, col("sb") / n])
        x = np.column_stack([col("mid_a"), col("mid_b")]) + off
        scatter = np.empty((len(n), 2, 2))
        scatter[:, 0, 0] = np.maximum(col("saa") / n - off[:, 0] ** 2, 0)
        scatter[:, 1, 1] = np.maximum(col("sbb") / n - off[:, 1] ** 2, 0)
        scatter[:, 0, 1] = scatter[:, 1, 0] = col("sab") / n - off[:, 0] * off[:, 1]
        lo, hi = np.column_stack([col("amin"), col("bmin")]), np.column_stack([col("amax"), col("bmax")])
        row = _evaluate(list(key[:-2]), (key[-2], key[-1]), n, x, scatter, lo, hi, len(n), p, cutoff, False)
        return pd.DataFrame([row], columns=columns)

    return run


def pair_candidates(records: list, group: list[str], profile: Profile, cutoff: float) -> list[tuple]:
    """Marker pairs of groups whose single scan found nothing: both markers' similarity in the rescan band."""
    low, high = profile.band_low * cutoff, min(profile.band_high * cutoff, profile.band_cap)
    per: dict[tuple, list[str]] = {}
    found = set()
    for r in records:
        g = tuple(r[c] for c in group)
        if r["separable"]:
            found.add(g)
        elif low < r["similarity"] < high:
            per.setdefault(g, []).append(r["key"][0])
    out = []
    for g, names in per.items():
        names = sorted(names)
        if g not in found:
            out += [(*g, a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return out


def scan_pairs(df: DataFrame, group: list[str], pairs: list[tuple], limits: DataFrame, profile: Profile,
               cutoff: float | None = None, bins: int = BINS_2D) -> DataFrame:
    """One record per (group, pair)."""
    if len(pairs) > BROADCAST_ROW_LIMIT:
        raise ValueError("too many marker pairs for one level; tighten the rescan band")
    c = profile.merge_cutoff if cutoff is None else cutoff
    fields = [df.schema[g] for g in group] + [T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]
    table = df.sparkSession.createDataFrame(pairs, T.StructType(fields))
    schema = _schema(df, group)
    run = _pair_task(profile, min(profile.pair_factor * c, profile.pair_cap), schema.fieldNames())
    return pair_knots(df, group, table, limits, bins).groupBy(*group, "a", "b").applyInPandas(run, schema)


def component_table(records: DataFrame, group: list[str]) -> DataFrame:
    """Records to one row per component: weight, mean, covariance and merged label."""
    d = F.size("key")
    step = lambda arr, width: F.slice(arr, F.col("comp") * width + 1, width)
    return records.select(*group, "key", "weights", "means", "covs", "merged", F.explode(F.sequence(F.lit(0), F.size("weights") - 1)).alias("comp")).select(
        *group, "key", "comp", F.element_at("weights", F.col("comp") + 1).alias("weight"), step("means", d).alias("mean"),
        step("covs", d * d).alias("cov"), F.element_at("merged", F.col("comp") + 1).alias("merged_to"))


def component_count_curve(df: DataFrame, group: list[str], markers: list[str], max_k: int = 10, diagonal: bool = False,
                          bins: int = BINS_1D) -> DataFrame:
    """BIC and mean log-likelihood for k = 1..max_k of every (group, marker)."""
    limits = group_limits(df, group, markers)
    knots = marker_knots(df, group, markers, limits, bins)
    schema = T.StructType([df.schema[g] for g in group] + [
        T.StructField("feature", T.StringType()), T.StructField("k", T.IntegerType()),
        T.StructField("ll", T.DoubleType()), T.StructField("bic", T.DoubleType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy(dtype=float)
        off = pdf["s"].to_numpy() / n
        x = (pdf["mid"].to_numpy() + off)[:, None]
        scatter = np.maximum(pdf["ss"].to_numpy() / n - off * off, 0.0)[:, None, None]
        rows = []
        for k in range(1, min(max_k, len(x)) + 1):
            fit = K.fit_mixture(n, x, scatter, k, diagonal=diagonal)
            rows.append([*key, k, fit.mean_ll, K.bic_of(fit, n.sum(), diagonal)])
        return pd.DataFrame(rows, columns=schema.fieldNames())

    return knots.groupBy(*group, "feature").applyInPandas(run, schema)


def dip_statistics(df: DataFrame, group: list[str], markers: list[str], bins: int = BINS_1D) -> DataFrame:
    """Dip statistic of every (group, marker) on its binned distribution."""
    knots = marker_knots(df, group, markers, group_limits(df, group, markers), bins)
    schema = T.StructType([df.schema[g] for g in group] + [
        T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), T.StructField("dip", T.DoubleType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(dtype=float)
        x = pdf["mid"].to_numpy() + pdf["s"].to_numpy() / n
        return pd.DataFrame([[*key, int(n.sum()), K.dip_statistic(x, n)]], columns=schema.fieldNames())

    return knots.groupBy(*group, "feature").applyInPandas(run, schema)
