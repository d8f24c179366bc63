"""Metagenes from loadings, and Dirichlet-multinomial mixtures on their counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markertree.session import bounded_rows


def metagenes(loadings: DataFrame, threshold: float = 0.03, components: list[str] | None = None) -> DataFrame:
    """Per component the genes in either tail: one more than lie beyond the threshold on that side.

    Loadings (feature, component, w) are selection-sized. Output (metagene, feature).
    """
    used = loadings.filter(F.col("component").isin(components)) if components else loadings
    low = Window.partitionBy("component").orderBy(F.asc("w"), F.asc("feature"))
    high = Window.partitionBy("component").orderBy(F.desc("w"), F.desc("feature"))
    everyone = Window.partitionBy("component")
    ranked = used.select(
        "feature", "component",
        F.row_number().over(low).alias("_lo"), F.row_number().over(high).alias("_hi"),
        (F.sum(F.when(F.col("w") < -threshold, 1).otherwise(0)).over(everyone) + 1).alias("_nlo"),
        (F.sum(F.when(F.col("w") > threshold, 1).otherwise(0)).over(everyone) + 1).alias("_nhi"))
    tail = lambda rank, n, name: ranked.filter(F.col(rank) <= F.col(n)).select(F.concat("component", F.lit(name)).alias("metagene"), "feature")
    return tail("_lo", "_nlo", "-").union(tail("_hi", "_nhi", "+"))


def metagene_counts(long: DataFrame, genes: DataFrame, cell: list[str] = ("cell_id",)) -> DataFrame:
    """Counts per cell and metagene (a gene may feed several)."""
    return long.join(genes, "feature").groupBy(*cell, "metagene").agg(F.sum("value").alias("value"))


def count_arrays(counts: DataFrame, names: list[str], cells: DataFrame, cell: list[str] = ("cell_id",)) -> DataFrame:
    """One array of counts per cell, zeros filled."""
    wide = counts.groupBy(*cell).pivot("metagene", names).agg(F.first("value"))
    return cells.join(wide, list(cell), "left").select(
        *cells.columns, F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in names]).alias("x"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 8, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift = np.where(small, shift - np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    inv = 1 / x
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift = np.where(small, shift - 1 / np.where(small, x, 1.0), shift)
        x = np.where(small, x + 1, x)
    inv2 = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 / 252))


@dataclass
class DirichletMixture:
    weights: np.ndarray
    alphas: np.ndarray
    history: list[float]


def _log_terms(x: np.ndarray, weights: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    n = x.sum(axis=1)
    out = np.empty((len(x), len(weights)))
    for j, a in enumerate(alphas):
        out[:, j] = np.log(weights[j]) + log_gamma(a.sum()) - log_gamma(n + a.sum()) + (log_gamma(x + a) - log_gamma(a)).sum(axis=1)
    return out


def fit_dirichlet(cells: DataFrame, width: int, k: int = 2, array: str = "x", max_iter: int = 300, tol: float = 1e-3) -> DirichletMixture:
    """EM with a fixed-point step for the concentrations; each round is one pass that returns only sums.

    The start splits cells by their share of the most variable count, which makes runs repeatable.
    """
    share = F.when(F.aggregate(array, F.lit(0.0), lambda s, v: s + v) > 0, F.transform(array, lambda v: v / F.aggregate(array, F.lit(0.0), lambda s, u: s + u))).otherwise(F.array_repeat(F.lit(1.0 / width), width))
    shares = cells.select(share.alias("p"))
    first = shares.agg(*[f(F.element_at("p", i + 1)).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    mean = np.array([first[f"m{i}"] for i in range(width)]) + 1e-3
    sd = np.sqrt(np.array([first[f"v{i}"] for i in range(width)]))
    lead = int(np.argmax(sd))
    alphas = np.empty((k, width))
    for j in range(k):
        p = mean.copy()
        p[lead] = max(p[lead] + sd[lead] * (2 * (j + 0.5) / k - 1), 1e-3)
        alphas[j] = 20.0 * p / p.sum()
    weights = np.full(k, 1.0 / k)
    history: list[float] = []
    for _ in range(max_iter):
        w, a = weights, alphas

        def run(batches, w=w, a=a):
            top, bottom, mass = np.zeros((k, width)), np.zeros(k), np.zeros(k)
            ll, n = 0.0, 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                x = np.vstack(pdf[array].to_numpy())
                logs = _log_terms(x, w, a)
                peak = logs.max(axis=1, keepdims=True)
                dens = np.exp(logs - peak)
                total = dens.sum(axis=1, keepdims=True)
                r = dens / total
                ll += float((peak + np.log(total)).sum())
                n += len(x)
                mass += r.sum(axis=0)
                size = x.sum(axis=1)
                for j in range(k):
                    top[j] += r[:, j] @ (digamma(x + a[j]) - digamma(a[j]))
                    bottom[j] += r[:, j] @ (digamma(size + a[j].sum()) - digamma(a[j].sum()))
            flat = np.concatenate([[n, ll], mass, bottom, top.ravel()])
            yield pd.DataFrame({"pos": np.arange(len(flat)), "v": flat})

        sums = cells.select(array).coalesce(4 * cells.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "pos long, v double")
        v = np.array([r["v"] for r in sorted(bounded_rows(sums.groupBy("pos").agg(F.sum("v").alias("v"))), key=lambda r: r["pos"])])
        n, ll, mass, bottom, top = v[0], v[1], v[2:2 + k], v[2 + k:2 + 2 * k], v[2 + 2 * k:].reshape(k, width)
        history.append(ll / n)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
        weights = np.maximum(mass / n, 1e-12)
        alphas = np.maximum(alphas * top / np.maximum(bottom, 1e-300)[:, None], 1e-6)
    return DirichletMixture(weights, alphas, history)


def dirichlet_labels(cells: DataFrame, model: DirichletMixture, array: str = "x") -> DataFrame:
    """Label and posterior of the best component, JVM-side (``lgamma`` differences of whole counts are sums of logs)."""
    alphas, weights = model.alphas, model.weights
    total = F.aggregate(array, F.lit(0.0), lambda s, v: s + v)

    def rising(alpha: float, count):
        steps = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0.0), lambda s, j: s + F.log(F.lit(float(alpha)) + j))

    logs = []
    for w, a in zip(weights, alphas):
        value = F.lit(float(np.log(w))) - rising(float(a.sum()), total)
        for i, ai in enumerate(a):
            value = value + rising(float(ai), F.element_at(array, i + 1))
        logs.append(value)
    out = cells.withColumn("_l", F.array(*logs)).withColumn("_top", F.array_max("_l"))
    return out.withColumn("label", F.array_position("_l", F.col("_top")).cast("int") - 1).withColumn(
        "posterior", F.lit(1.0) / F.aggregate("_l", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_top")))).drop("_l", "_top")
