"""Helpers that run inside tasks on one candidate's compressed values ("knots").

A knot is a bin of equal or close values with its count, mean, scatter and range. Spark
builds the knots with map-side combine (see ``scan``); a candidate never has more of them than
the bin grid allows, so each call here is small whatever the table size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RIDGE = 1e-6
TINY = 1e-300


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    mean_ll: float
    mass: np.ndarray       # responsibility mass per component
    first: np.ndarray      # sum of r * x
    second: np.ndarray     # sum of r * x x'
    iterations: int

    @property
    def k(self) -> int:
        return len(self.weights)


def log_densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs)):
        if d == 1:
            v = c[0, 0]
            out[:, j] = -0.5 * (np.log(2 * np.pi * v) + (x[:, 0] - m[0]) ** 2 / v)
        else:
            chol = np.linalg.cholesky(c)
            z = np.linalg.solve(chol, (x - m).T)
            out[:, j] = -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
    return out


def _responsibilities(x, weights, means, covs):
    logs = log_densities(x, means, covs) + np.log(np.maximum(weights, TINY))
    top = logs.max(axis=1, keepdims=True)
    dens = np.exp(logs - top)
    total = dens.sum(axis=1, keepdims=True)
    return dens / total, (top + np.log(total))[:, 0]


def _maximize(n, x, scatter, resp, diagonal):
    """Weighted moments; the scatter inside each knot counts as spread."""
    r = resp * n[:, None]
    mass = r.sum(axis=0) + 10 * np.finfo(float).eps
    first = r.T @ x
    means = first / mass[:, None]
    d = x.shape[1]
    covs = np.empty((len(mass), d, d))
    second = np.empty_like(covs)
    for j in range(len(mass)):
        diff = x - means[j]
        spread = (r[:, j, None] * diff).T @ diff + np.tensordot(r[:, j], scatter, axes=(0, 0))
        if diagonal:
            spread = np.diag(np.diag(spread))
        covs[j] = spread / mass[j]
        second[j] = spread + mass[j] * np.outer(means[j], means[j])
        covs[j].flat[:: d + 1] += RIDGE
    return mass, first, second, means, covs


def _start(n, x, k, minor: bool = False):
    """Deterministic start: weighted quantiles along the main axis, then a few Lloyd rounds.

    ``minor`` slices across the shortest axis instead, without Lloyd rounds, which would turn it back.
    """
    total = n.sum()
    centre = (n @ x) / total
    diff = x - centre
    axis = np.zeros(x.shape[1])
    axis[0] = 1.0
    if x.shape[1] > 1:
        _, vectors = np.linalg.eigh((n[:, None] * diff).T @ diff)
        axis = vectors[:, 0 if minor else -1]
        if axis[np.abs(axis).argmax()] < 0:
            axis = -axis
    along = diff @ axis
    order = np.argsort(along, kind="stable")
    upto = np.cumsum(n[order])
    if minor:
        label = np.minimum(((upto - n[order] / 2) / total * k).astype(int), k - 1)
        resp = np.zeros((len(x), k))
        resp[order, label] = 1.0
        return resp
    at = np.searchsorted(upto, (np.arange(k) + 0.5) / k * total)
    centres = x[order[np.minimum(at, len(x) - 1)]].astype(float)
    label = None
    for _ in range(20):
        dist = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        new = dist.argmin(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        mass = np.bincount(label, weights=n, minlength=k)
        for j in np.flatnonzero(mass > 0):
            mine = label == j
            centres[j] = (n[mine] @ x[mine]) / mass[j]
    resp = np.zeros((len(x), k))
    resp[np.arange(len(x)), label] = 1.0
    return resp


def fit_mixture(n, x, scatter, k: int, tol: float = 1e-3, max_iter: int = 100, diagonal: bool = False,
                trace: list | None = None) -> Mixture:
    """Expectation-maximisation on weighted knots. ``trace`` collects the mean log-likelihood per round.

    In two dimensions a second start across the short axis is tried too, and the likelier fit wins.
    """
    fit = _run_em(n, x, scatter, _start(n, x, k), tol, max_iter, diagonal, trace)
    if k > 1 and x.shape[1] > 1:
        second = _run_em(n, x, scatter, _start(n, x, k, minor=True), tol, max_iter, diagonal, None)
        if second.mean_ll > fit.mean_ll:
            return second
    return fit


def _run_em(n, x, scatter, resp, tol, max_iter, diagonal, trace) -> Mixture:
    total = n.sum()
    mass, first, second, means, covs = _maximize(n, x, scatter, resp, diagonal)
    weights = mass / mass.sum()
    previous, rounds = -np.inf, 0
    for rounds in range(1, max_iter + 1):
        resp, logs = _responsibilities(x, weights, means, covs)
        ll = float(n @ logs) / total
        if trace is not None:
            trace.append(ll)
        mass, first, second, means, covs = _maximize(n, x, scatter, resp, diagonal)
        weights = mass / mass.sum()
        if abs(ll - previous) < tol:
            break
        previous = ll
    _, logs = _responsibilities(x, weights, means, covs)
    return Mixture(weights, means, covs, float(n @ logs) / total, mass, first, second, rounds)


def parameters(k: int, d: int, diagonal: bool = False) -> float:
    return k - 1 + (2 * k * d if diagonal else k * d + k * d * (d + 1) / 2)


def bic_of(fit: Mixture, total: float, diagonal: bool = False) -> float:
    return -2 * total * fit.mean_ll + parameters(fit.k, fit.means.shape[1], diagonal) * np.log(total)


def elbow_index(curve: list[float]) -> int:
    """1-based point farthest from the chord between the ends of the curve."""
    if len(curve) < 3:
        return 1
    y = np.asarray(curve)
    k = np.arange(len(y), dtype=float)
    rise, run = y[-1] - y[0], float(len(y) - 1)
    return int(np.abs(rise * k - run * (y - y[0])).argmax()) + 1


def pick_k(curve: list[float], mode: str = "bic") -> int:
    lowest = int(np.argmin(curve)) + 1
    return {"bic": min(lowest, elbow_index(curve)), "bic_min": lowest, "bic_elbow": elbow_index(curve)}[mode]


def overlap(m1, c1, m2, c2) -> float:
    """e^(-Bhattacharyya distance); zero when a determinant is not positive."""
    pooled = (c1 + c2) / 2
    det, d1, d2 = np.linalg.det(pooled), np.linalg.det(c1), np.linalg.det(c2)
    if det <= 0 or d1 <= 0 or d2 <= 0:
        return 0.0
    gap = m1 - m2
    distance = gap @ np.linalg.solve(pooled, gap) / 8 + 0.5 * np.log(det) - 0.25 * np.log(d1) - 0.25 * np.log(d2)
    return float(np.exp(-distance))


def merge_components(fit: Mixture, cutoff: float, merge_tail=None) -> tuple[list[int], float]:
    """Merge the most similar pair while it is too similar; return the merged label per component
    and the smallest similarity of the last pair table.

    Mass and sums of the E-step add up, so a merged component's mean and biased covariance are exact
    without another pass. ``merge_tail(similarity)`` may ask for a merge of hardly overlapping pairs.
    """
    groups = [[j] for j in range(fit.k)]
    mass, first, second = list(fit.mass), list(fit.first), list(fit.second)
    means, covs = list(fit.means), list(fit.covs)
    lowest = 1.0
    while len(groups) > 1:
        pairs = [(overlap(means[i], covs[i], means[j], covs[j]), i, j)
                 for i in range(len(groups)) for j in range(i + 1, len(groups))]
        lowest = min(p[0] for p in pairs)
        best, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        if not (best > cutoff or (merge_tail is not None and merge_tail(best))):
            break
        groups[i] += groups.pop(j)
        mass[i] += mass.pop(j)
        first[i] = first[i] + first.pop(j)
        second[i] = second[i] + second.pop(j)
        means.pop(j), covs.pop(j)
        means[i] = first[i] / mass[i]
        covs[i] = second[i] / mass[i] - np.outer(means[i], means[i])
    merged = [0] * fit.k
    for label, members in enumerate(groups):
        for j in members:
            merged[j] = label
    return merged, lowest


def merged_labels(x: np.ndarray, weights, means, covs, merged: list[int]) -> np.ndarray:
    """Hard label: the merged class with the largest summed posterior, lowest index on ties."""
    resp, _ = _responsibilities(x, np.asarray(weights), np.asarray(means), np.asarray(covs))
    sums = np.zeros((len(x), max(merged) + 1))
    for j, label in enumerate(merged):
        sums[:, label] += resp[:, j]
    return sums.argmax(axis=1)


def gaussian_ll(n, x, scatter) -> float:
    """Mean log-likelihood of one Gaussian on knots, from moments."""
    total = n.sum()
    mean = (n @ x) / total
    diff = x - mean
    s = ((n[:, None] * diff).T @ diff + np.tensordot(n, scatter, axes=(0, 0))) / total
    d = x.shape[1]
    ridged = s + RIDGE * np.eye(d)
    return float(-0.5 * (d * np.log(2 * np.pi) + np.log(np.linalg.det(ridged)) + np.trace(np.linalg.solve(ridged, s))))


# ------------------------------------------------------------------ unimodality

def _convex_gap(x: np.ndarray, below: np.ndarray, above: np.ndarray, m: int) -> float:
    """Largest excess of the step function over its greatest convex minorant left of mode ``m``.

    ``below``/``above`` are the values just before and at each point. The minorant runs through
    the ``below`` values up to and including the mode.
    """
    hull = [0]
    for i in range(1, m + 1):
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (below[b] - below[a]) * (x[i] - x[a]) < (below[i] - below[a]) * (x[b] - x[a]):
                break
            hull.pop()
        hull.append(i)
    if m == 0:
        return 0.0
    minorant = np.interp(x[:m], x[hull], below[hull])
    return float((above[:m] - minorant).max())


def dip_statistic(x: np.ndarray, n: np.ndarray) -> float:
    """Dip: the smallest sup-distance between the sample's distribution and any unimodal one.

    For a fixed mode the best unimodal function is convex before and concave after it, so its
    distance is half the larger of the two one-sided excesses. The left excess grows and the right one shrinks
    as the mode moves right, so a bisection over modes finds the minimum.
    """
    keep = n > 0
    order = np.argsort(x[keep], kind="stable")
    x, n = x[keep][order].astype(float), n[keep][order].astype(float)
    if len(x) < 2:
        return 0.0
    above = np.cumsum(n) / n.sum()
    below = np.concatenate([[0.0], above[:-1]])
    mirror_x, mirror_below, mirror_above = -x[::-1], 1 - above[::-1], 1 - below[::-1]
    last = len(x) - 1
    left = lambda m: _convex_gap(x, below, above, m)
    right = lambda m: _convex_gap(mirror_x, mirror_below, mirror_above, last - m)
    lo, hi = 0, last
    while lo < hi:
        mid = (lo + hi) // 2
        if left(mid) >= right(mid):
            hi = mid
        else:
            lo = mid + 1
    best = max(left(lo), right(lo))
    if lo > 0:
        best = min(best, max(left(lo - 1), right(lo - 1)))
    return best / 2


# ------------------------------------------------------------------ rules

def cut_points(weights, means, covs, merged: list[int], chosen: int, lo: float, hi: float) -> tuple[list[float], bool]:
    """Where membership in the chosen merged class changes along [lo, hi], and whether it holds at ``lo``."""
    grid = np.linspace(lo, hi, 8193)
    inside = lambda v: merged_labels(np.atleast_1d(v)[:, None], weights, means, covs, merged) == chosen
    member = inside(grid)
    cuts = []
    for i in np.flatnonzero(member[1:] != member[:-1]):
        a, b = grid[i], grid[i + 1]
        state = member[i]
        for _ in range(60):
            mid = (a + b) / 2
            if mid <= a or mid >= b:
                break
            if inside(mid)[0] == state:
                a = mid
            else:
                b = mid
        cuts.append(float(a))
    return cuts, bool(member[0])
