"""Full-table expectation-maximisation in any number of markers, many models at once.

Every round is one pass: Arrow batches compute responsibilities for all models and emit only the sums
(mass, first and second moments) per component; Spark adds them up. The table may be as large as it likes, the
state is (models x components x d^2) numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.operators import knots as K
from markertree.session import bounded_rows, discard, materialize


@dataclass
class GaussianModel:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    mean_ll: float = -np.inf
    n: int = 0
    diagonal: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def bic(self) -> float:
        return -2 * self.n * self.mean_ll + K.parameters(self.k, self.means.shape[1], self.diagonal) * np.log(self.n)


START_CELLS = 4096
GRID_MARKERS = 12
GRID_BINS = 256


def _start_cells(df: DataFrame, markers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, mean and covariance of at most ``START_CELLS`` grid cells that hold all rows, to place the first centres.

    The grid cuts the first ``GRID_MARKERS`` markers into at most ``GRID_BINS`` bins at equal shares of their rows; every row counts, so a value of many
    rows has its weight.
    """
    gridded = markers[:GRID_MARKERS]
    bins = max(2, min(GRID_BINS, int(START_CELLS ** (1 / len(gridded)) + 1e-9)))
    shares = [i / bins for i in range(1, bins)]
    cuts = df.agg(*[F.percentile_approx(F.col(m).cast("double"), shares, 10_000).alias(f"q{i}") for i, m in enumerate(gridded)]).first()

    def passed(marker: str, values: list[float]) -> Column:
        return F.size(F.filter(F.lit(sorted(set(values))).cast("array<double>"), lambda c: F.col(marker) > c))

    above = [passed(m, cuts[f"q{i}"] or []).alias(f"_g{i}") for i, m in enumerate(gridded)]
    placed = df.select(*[F.col(m).cast("double").alias(m) for m in markers]).select(*markers, *above)
    pairs = [(i, j) for i in range(len(markers)) for j in range(i, len(markers))]
    cells = bounded_rows(placed.groupBy(*[f"_g{i}" for i in range(len(gridded))]).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"m{i}") for i, m in enumerate(markers)],
        *[F.covar_pop(markers[i], markers[j]).alias(f"c{i}_{j}") for i, j in pairs]), START_CELLS)
    cells.sort(key=lambda r: [r[f"_g{i}"] for i in range(len(gridded))])
    n = np.array([r["n"] for r in cells], dtype=float)
    means = np.array([[r[f"m{i}"] for i in range(len(markers))] for r in cells], dtype=float)
    covs = np.zeros((len(cells), len(markers), len(markers)))
    for i, j in pairs:
        covs[:, i, j] = covs[:, j, i] = [r[f"c{i}_{j}"] for r in cells]
    return n, means, covs


def _start_models(n: np.ndarray, points: np.ndarray, scatter: np.ndarray, ks: list[int], diagonal: bool) -> list[GaussianModel]:
    centred = points - n @ points / n.sum()
    scale = np.sqrt((n @ (centred * centred) + n @ np.diagonal(scatter, axis1=1, axis2=2)) / n.sum())
    scale[scale == 0] = 1.0
    models = []
    for k in ks:
        resp = K._start(n, points / scale, min(k, len(points)))
        mass, _, _, means, covs = K._maximize(n, points, scatter, resp, diagonal)
        models.append(GaussianModel(mass / mass.sum(), means, covs, diagonal=diagonal))
    return models


def em_pass(df: DataFrame, markers: list[str], models: list[GaussianModel]) -> dict[int, tuple]:
    """One round for all models: {model: (n, log-likelihood sum, mass, first, second)}."""
    d = len(markers)
    packed = [(m.weights, m.means, m.covs) for m in models]

    def run(batches):
        held = [[0.0, np.zeros(len(w)), np.zeros((len(w), d)), np.zeros((len(w), d, d))] for w, _, _ in packed]
        n = 0
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            n += len(x)
            for state, (w, means, covs) in zip(held, packed):
                resp, logs = K._responsibilities(x, w, means, covs)
                state[0] += logs.sum()
                state[1] += resp.sum(axis=0)
                state[2] += resp.T @ x
                for j in range(len(w)):
                    state[3][j] += (resp[:, j, None] * x).T @ x
        rows = []
        for i, (ll, mass, first, second) in enumerate(held):
            flat = np.concatenate([[n, ll], mass, first.ravel(), second.ravel()])
            rows += [(i, p, float(v)) for p, v in enumerate(flat)]
        yield pd.DataFrame(rows, columns=["model", "pos", "v"])

    sums = df.select(*[F.col(m).cast("double") for m in markers]).coalesce(
        4 * df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "model int, pos int, v double")
    flat: dict[int, dict[int, float]] = {}
    for r in bounded_rows(sums.groupBy("model", "pos").agg(F.sum("v").alias("v")), 5_000_000):
        flat.setdefault(r["model"], {})[r["pos"]] = r["v"]
    out = {}
    for i, m in enumerate(models):
        v = np.array([flat[i][p] for p in range(len(flat[i]))])
        k = m.k
        mass, rest = v[2:2 + k], v[2 + k:]
        out[i] = (int(v[0]), v[1], mass, rest[:k * d].reshape(k, d), rest[k * d:].reshape(k, d, d))
    return out


def fit_models(df: DataFrame, markers: list[str], ks: list[int], diagonal: bool = False, tol: float = 1e-3,
               max_iter: int = 100, trace: list | None = None) -> list[GaussianModel]:
    """Fit one mixture per k; all unfinished models share each pass.

    Values are centred on their mean before summing, which keeps second moments well conditioned.
    """
    n_start, points, scatter = _start_cells(df, markers)
    centre = n_start @ points / n_start.sum()
    shifted = materialize(df.select(*[(F.col(m).cast("double") - F.lit(float(c))).alias(m) for m, c in zip(markers, centre)]))
    models = _start_models(n_start, points - centre, scatter, ks, diagonal)
    live = list(range(len(models)))
    for _ in range(max_iter):
        if not live:
            break
        sums = em_pass(shifted, markers, [models[i] for i in live])
        still = []
        for slot, i in enumerate(live):
            n, ll, mass, first, second = sums[slot]
            mass = mass + 10 * np.finfo(float).eps
            means = first / mass[:, None]
            covs = second / mass[:, None, None] - np.einsum("ki,kj->kij", means, means)
            if diagonal:
                covs = covs * np.eye(len(markers))
            covs = covs + K.RIDGE * np.eye(len(markers))
            mean_ll = ll / n
            done = abs(mean_ll - models[i].mean_ll) < tol
            if done:
                models[i].mean_ll, models[i].n = mean_ll, n
            else:
                models[i] = GaussianModel(mass / mass.sum(), means, covs, mean_ll, n, diagonal)
                still.append(i)
            if trace is not None:
                trace.append((models[i].k, mean_ll))
        live = still
    discard(shifted)
    for m in models:
        m.means = m.means + centre
    return models


def best_by_bic(df: DataFrame, markers: list[str], max_k: int = 50, diagonal: bool = False) -> GaussianModel:
    """Model-size search: the k in 1..max_k with the lowest BIC."""
    return min(fit_models(df, markers, list(range(1, max_k + 1)), diagonal), key=lambda m: m.bic())
