"""Student-t tail and quantile for one-row regression summaries (no numeric library needed)."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, dof: float) -> float:
    """P(|T| >= |t|)."""
    return regularised_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(prob: float, dof: float) -> float:
    """The ``prob`` quantile for ``prob`` in (0.5, 1), by bisection on the two-sided tail."""
    tail = 2.0 * (1.0 - prob)
    low, high = 0.0, 1.0
    while two_sided_p(high, dof) > tail:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if two_sided_p(mid, dof) > tail:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)
