"""Tails of distributions that the driver needs: normal, chi-square and its quantile. No scipy."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / max(tiny, step * d + b) if step * d + b >= 0 else 1 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * value


def chi2_tail(x: float, freedom: int) -> float:
    """P(X > x)."""
    return max(0.0, min(1.0, 1 - _lower_gamma(freedom / 2, x / 2)))


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, max(10.0, 4.0 * freedom)
    while 1 - chi2_tail(high, freedom) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi2_tail(middle, freedom) < p else (low, middle)
    return (low + high) / 2


def mann_whitney(u: float, n1: int, n2: int, ties: int) -> float:
    """Two-sided p of U by the tie-corrected normal approximation with continuity; ``ties`` is the sum of t^3 - t."""
    n = n1 + n2
    spread = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if spread <= 0:
        return 1.0
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(spread)
    return min(1.0, 2 * normal_tail(max(z, 0.0)))


def holm(values: list[float]) -> list[float]:
    """Step-down adjusted p values, monotone and at most 1."""
    order = sorted(range(len(values)), key=lambda k: values[k])
    found, worst = [0.0] * len(values), 0.0
    for place, k in enumerate(order):
        worst = max(worst, min(1.0, values[k] * (len(values) - place)))
        found[k] = worst
    return found
