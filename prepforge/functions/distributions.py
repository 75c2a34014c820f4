"""Tail probabilities for one-row results (no table work): Student t, F, chi-square."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def t_cdf(t: float, dof: float) -> float:
    tail = 0.5 * t_two_sided(t, dof)
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    """Inverse of ``t_cdf`` by bisection."""
    lo, hi = -1.0, 1.0
    while t_cdf(lo, dof) > p:
        lo *= 2
    while t_cdf(hi, dof) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) for chi-square: series below dof/2 + 1, continued fraction above."""
    a, half = dof / 2.0, x / 2.0
    if half <= 0:
        return 1.0
    front = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= half / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = half + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h
