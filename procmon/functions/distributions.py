"""Quantiles the control limits need; evaluated once per fitted model."""

from __future__ import annotations

from math import exp, lgamma, log
from statistics import NormalDist


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    tiny = 1e-300
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for step in range(20_000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        change = c * d
        value *= change
        if step and abs(change - 1.0) < 1e-16:
            break
    return front * (value - 1.0)


def f_quantile(probability: float, dfn: float, dfd: float) -> float:
    """Quantile of the F distribution: bisection on the matching beta distribution."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if beta_cdf(middle, dfn / 2.0, dfd / 2.0) < probability:
            low = middle
        else:
            high = middle
    x = 0.5 * (low + high)
    # The upper tail keeps its digits through the mirrored distribution.
    tail = _beta_quantile_upper(1.0 - probability, dfd / 2.0, dfn / 2.0) if x > 0.5 else 1.0 - x
    return dfd * (1.0 - tail) / (dfn * tail)


def _beta_quantile_upper(probability: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(300):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if beta_cdf(middle, a, b) < probability:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)
