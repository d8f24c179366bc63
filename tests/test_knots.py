"""Numeric helpers against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markertree.operators import knots as K
from markertree.operators.metagenes import digamma, log_gamma


def as_knots(x):
    values, counts = np.unique(x, return_counts=True)
    return counts.astype(float), values[:, None].astype(float), np.zeros((len(values), 1, 1))


def two_modes(gap=5.0, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(-gap / 2, 1, int(n * 0.3)), rng.normal(gap / 2, 1, n - int(n * 0.3))])


def test_em_never_loses_likelihood_and_recovers_modes():
    n, x, s = as_knots(two_modes())
    trace = []
    fit = K.fit_mixture(n, x, s, 2, tol=1e-6, trace=trace)
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))
    assert np.allclose(sorted(fit.means.ravel()), [-2.5, 2.5], atol=0.15)
    assert fit.weights.sum() == pytest.approx(1.0)


def test_binned_fit_is_close_to_exact():
    x = two_modes()
    exact = K.fit_mixture(*as_knots(x), 2, tol=1e-8)
    edges = np.linspace(x.min(), x.max(), 513)
    at = np.clip(np.digitize(x, edges) - 1, 0, 511)
    ids = np.unique(at)
    n = np.array([(at == i).sum() for i in ids], float)
    mid = np.array([x[at == i].mean() for i in ids])[:, None]
    var = np.array([x[at == i].var() for i in ids])[:, None, None]
    binned = K.fit_mixture(n, mid, var, 2, tol=1e-8)
    assert np.allclose(np.sort(exact.means.ravel()), np.sort(binned.means.ravel()), atol=1e-2)


def test_one_component_equals_closed_form():
    n, x, s = as_knots(two_modes())
    assert K.fit_mixture(n, x, s, 1).mean_ll == pytest.approx(K.gaussian_ll(n, x, s), abs=1e-6)


def test_bic_and_elbow_rules():
    assert K.pick_k([10.0, 2.0, 1.9, 1.8], "bic") == 2
    assert K.pick_k([10.0, 2.0, 1.9, 1.8], "bic_min") == 4
    assert K.pick_k([1.0], "bic") == 1
    assert K.elbow_index([5.0, 4.0]) == 1


def test_merge_matches_posterior_merging():
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 0.5, 2500)
    n, v, s = as_knots(x)
    fit = K.fit_mixture(n, v, s, 4, tol=1e-9, max_iter=500)
    merged, lowest = K.merge_components(fit, 0.1)
    # brute force: merge on the data's posteriors
    resp, _ = K._responsibilities(v, fit.weights, fit.means, fit.covs)
    groups, post = [[j] for j in range(4)], [resp[:, j] for j in range(4)]
    mu, var = list(fit.means[:, 0]), list(fit.covs[:, 0, 0])
    low = 1.0
    while len(groups) > 1:
        sims = {(i, j): K.overlap(np.array([mu[i]]), np.array([[var[i]]]), np.array([mu[j]]), np.array([[var[j]]]))
                for i in range(len(groups)) for j in range(i + 1, len(groups))}
        low = min(sims.values())
        (i, j), best = max(sims.items(), key=lambda kv: kv[1])
        if best <= 0.1:
            break
        groups[i] += groups.pop(j)
        post[i] = post[i] + post.pop(j)
        mu.pop(j), var.pop(j)
        w = post[i] * n / (post[i] * n).sum()
        mu[i] = float(w @ v[:, 0])
        var[i] = float(w @ (v[:, 0] - mu[i]) ** 2)
    want = [next(g for g, members in enumerate(groups) if j in members) for j in range(4)]
    assert merged == want and lowest == pytest.approx(low, abs=1e-3)


def brute_dip(x, n):
    above = np.cumsum(n) / n.sum()
    below = np.concatenate([[0], above[:-1]])
    last = len(x) - 1
    return min(max(K._convex_gap(x, below, above, m), K._convex_gap(-x[::-1], 1 - above[::-1], 1 - below[::-1], last - m))
               for m in range(len(x))) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=60))
def test_dip_bisection_equals_all_modes(values):
    v, n = np.unique(values, return_counts=True)
    if len(v) > 1:
        assert K.dip_statistic(v.astype(float), n) == pytest.approx(brute_dip(v.astype(float), n.astype(float)), abs=1e-12)


def test_dip_reference_values():
    assert K.dip_statistic(np.arange(50.0), np.ones(50)) == pytest.approx(0.01)
    assert K.dip_statistic(np.array([0.0, 1.0]), np.array([5.0, 5.0])) == pytest.approx(0.25)
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=2000), two_modes(6)
    assert K.dip_statistic(one, np.ones(2000)) < 0.015 < K.dip_statistic(two, np.ones(len(two)))


def test_cut_points_reproduce_labels():
    n, x, s = as_knots(two_modes())
    fit = K.fit_mixture(n, x, s, 2)
    cuts, inside = K.cut_points(fit.weights, fit.means, fit.covs, [0, 1], 1, x.min(), x.max())
    member = K.merged_labels(x, fit.weights, fit.means, fit.covs, [0, 1]) == 1
    by_cuts = (np.searchsorted(cuts, x[:, 0], side="left") % 2 == 0) == inside
    assert (member == by_cuts).mean() > 0.999


def test_gamma_functions():
    import math

    x = np.array([0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 40.0, 1e4])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], atol=1e-10)
    h = 1e-5
    assert np.allclose(digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rtol=1e-4, atol=1e-4)
