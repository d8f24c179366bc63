"""Column functions for Gaussian statistics; pure expressions, no Python at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2.0 * math.pi)
RIDGE = 1e-6


def col_of(c: Column | str | float | int) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def normal_logpdf(x, mean, var) -> Column:
    x, mean, var = col_of(x), col_of(mean), col_of(var)
    return F.lit(-0.5) * (F.lit(LN_2PI) + F.log(var) + (x - mean) * (x - mean) / var)


def det2(vxx, vyy, vxy) -> Column:
    return col_of(vxx) * col_of(vyy) - col_of(vxy) * col_of(vxy)


def bivariate_normal_logpdf(x, y, mx, my, vxx, vyy, vxy) -> Column:
    dx, dy = col_of(x) - col_of(mx), col_of(y) - col_of(my)
    vxx, vyy, vxy = col_of(vxx), col_of(vyy), col_of(vxy)
    det = det2(vxx, vyy, vxy)
    quad = (vyy * dx * dx - F.lit(2.0) * vxy * dx * dy + vxx * dy * dy) / det
    return F.lit(-LN_2PI) - F.lit(0.5) * F.log(det) - F.lit(0.5) * quad


def gauss_ll_1d(var_pop, ridge: float = RIDGE) -> Column:
    """Mean log-likelihood of one fitted Gaussian, from its population variance."""
    v = col_of(var_pop)
    s = v + F.lit(ridge)
    return F.lit(-0.5) * (F.lit(LN_2PI) + F.log(s) + v / s)


def gauss_ll_2d(vxx, vyy, vxy, ridge: float = RIDGE) -> Column:
    vxx, vyy, vxy = col_of(vxx), col_of(vyy), col_of(vxy)
    sxx, syy = vxx + F.lit(ridge), vyy + F.lit(ridge)
    det = sxx * syy - vxy * vxy
    trace = (syy * vxx - F.lit(2.0) * vxy * vxy + sxx * vyy) / det
    return F.lit(-0.5) * (F.lit(2.0 * LN_2PI) + F.log(det) + trace)


def bhattacharyya(m1, v1, m2, v2) -> Column:
    """Bhattacharyya distance of two 1-D Gaussians; null when a variance is not positive."""
    m1, v1, m2, v2 = map(col_of, (m1, v1, m2, v2))
    pooled = (v1 + v2) / F.lit(2.0)
    dist = (
        (m1 - m2) * (m1 - m2) / pooled / F.lit(8.0)
        + F.lit(0.5) * F.log(pooled)
        - F.lit(0.25) * F.log(v1)
        - F.lit(0.25) * F.log(v2)
    )
    return F.when((v1 > 0) & (v2 > 0), dist)


def bhattacharyya_2d(m1: tuple, c1: tuple, m2: tuple, c2: tuple) -> Column:
    """Same for 2-D; ``m=(x, y)``, ``c=(vxx, vyy, vxy)``; null for singular covariances."""
    dx, dy = col_of(m1[0]) - col_of(m2[0]), col_of(m1[1]) - col_of(m2[1])
    p = [(col_of(a) + col_of(b)) / F.lit(2.0) for a, b in zip(c1, c2)]
    det, det_1, det_2 = det2(*p), det2(*c1), det2(*c2)
    quad = (p[1] * dx * dx - F.lit(2.0) * p[2] * dx * dy + p[0] * dy * dy) / det
    dist = quad / F.lit(8.0) + F.lit(0.5) * F.log(det) - F.lit(0.25) * (F.log(det_1) + F.log(det_2))
    return F.when((det > 0) & (det_1 > 0) & (det_2 > 0), dist)


def mixture_params(k, d, covariance: str = "full") -> Column:
    """Free parameters of a k-component mixture in d dimensions."""
    k, d = col_of(k), col_of(d)
    if covariance == "diag":
        return k - F.lit(1.0) + F.lit(2.0) * k * d
    return k - F.lit(1.0) + k * d + k * d * (d + F.lit(1.0)) / F.lit(2.0)


def gmm_bic(mean_ll, n, k, d, covariance: str = "full") -> Column:
    n = col_of(n)
    return F.lit(-2.0) * n * col_of(mean_ll) + mixture_params(k, d, covariance) * F.log(n)


def gaussian_crossing(m1, sd1, w1, m2, sd2, w2) -> Column:
    """Point between the means where two weighted Gaussians are equally dense.

    Null when no root lies between the means.
    """
    m1, sd1, w1, m2, sd2, w2 = map(col_of, (m1, sd1, w1, m2, sd2, w2))
    v1, v2 = sd1 * sd1, sd2 * sd2
    two = F.lit(2.0)
    a = F.lit(1.0) / (two * v1) - F.lit(1.0) / (two * v2)
    b = m2 / v2 - m1 / v1
    c = m1 * m1 / (two * v1) - m2 * m2 / (two * v2) - F.log(sd2 * w1 / (sd1 * w2))
    disc = b * b - F.lit(4.0) * a * c
    lo, hi = F.least(m1, m2), F.greatest(m1, m2)
    inside = lambda r: F.when((r > lo) & (r < hi), r)
    linear = inside(-c / b)
    root = lambda sign: inside((-b + F.lit(sign) * F.sqrt(disc)) / (two * a))
    return (
        F.when(F.abs(a) < 1e-12, linear)
        .when(disc >= 0, F.coalesce(root(1.0), root(-1.0)))
    )


def binary_entropy(p) -> Column:
    """Entropy in bits of a two-way split with share ``p``; zero at the ends."""
    p = col_of(p)
    q = F.lit(1.0) - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - q * F.log2(q))


def posterior_two(log_dens_0, log_dens_1, w0) -> Column:
    """Posterior of class 0 from two log densities and the weight of class 0."""
    w0 = col_of(w0)
    odds = F.log(F.lit(1.0) - w0) + col_of(log_dens_1) - F.log(w0) - col_of(log_dens_0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(odds))


def diagonal_cosine(means: list) -> Column:
    """Sum of the means over their norm: orientation score of a multi-marker side."""
    cols = [col_of(m) for m in means]
    total = cols[0]
    square = cols[0] * cols[0]
    for c in cols[1:]:
        total, square = total + c, square + c * c
    return total / F.sqrt(square)


def hashed_normal(seed: int, *keys) -> Column:
    """Standard normal draw fixed by the keys and the seed (Box-Muller on xxhash64)."""
    span = F.lit(float(2**52))
    unit = lambda salt: (
        F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *[col_of(k) for k in keys]), F.lit(2**52)) + F.lit(0.5)
    ) / span
    return F.sqrt(F.lit(-2.0) * F.log(unit(1))) * F.cos(F.lit(2.0 * math.pi) * unit(2))


def array_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def array_norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(col_of(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda s, v: s + v))
