"""Special functions in numpy, for kernels that SQL has no function for."""

from __future__ import annotations

import math

import numpy as np

erfc = np.vectorize(math.erfc, otypes=[float])
gammaln = np.vectorize(math.lgamma, otypes=[float])


def normal_sf(z):
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def gamma_tail(observed: float, mean: float, sd: float, skew: float, floor: float = 0.0) -> tuple[float, str]:
    """P(X >= observed) of a shifted gamma with these moments; of a normal where the skew is
    not positive."""
    if sd <= 0:
        return (1.0 if observed <= mean else floor), "degenerate"
    if skew <= 1e-6:
        return max(floor, float(normal_sf((observed - mean) / sd))), "normal"
    shape = 4 / skew**2
    scale = sd * skew / 2
    return max(floor, gammainc_upper(shape, (observed - (mean - shape * scale)) / scale)), "gamma"
