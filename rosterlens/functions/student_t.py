"""Student-t tail probability for one test result (a scalar on the driver, never per row).

Uses the regularised incomplete beta function by its continued fraction (modified Lentz scheme).
"""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300

    def guard(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom."""
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_tail_p(f: float, dof1: float, dof2: float) -> float:
    """P(F > f) for the F distribution."""
    return beta_inc(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * f))


def chi2_tail_p(x: float, dof: float) -> float:
    """P(X > x) for the chi-square distribution (series for the lower part, fraction for the upper)."""
    if x <= 0.0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    front = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= h / k
            total += term
        return 1.0 - front * total
    b = h + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 10_000):
        step = i * (a - i)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value
