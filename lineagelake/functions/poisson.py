"""Log-likelihood ratio of a read depth against a band around the mean depth."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWEST = -230.2585  # ln 1e-100


def _pmf(n: float, mean: float) -> float:
    return n * math.log(mean) - mean - math.lgamma(n + 1)


def _interval(n: float, mean: float) -> float:
    """ln of the normal probability of [n - 0.5, n + 0.5], both variance and mean `mean`."""
    scale = math.sqrt(2 * mean)
    p = 0.5 * (math.erf((mean - n + 0.5) / scale) - math.erf((mean - n - 0.5) / scale))
    return math.log(p) if p >= 1e-100 else _LOWEST


def band_ratio(n: float, mean: float) -> float:
    """0 within [floor(mean / sqrt 2), ceil(mean * sqrt 2)]; outside, ln P(n) less ln P of
    the band's edge under the mean scaled to that edge, at most 0.

    P is the exact Poisson mass for means up to 20 above and 170 below, the normal interval
    beyond. More than 20 deviations above the edge count as ln 1e-100."""
    low, high = mean / math.sqrt(2), mean * math.sqrt(2)
    top, bottom = math.ceil(high), math.floor(low)
    if n > top:
        if n - top >= 20 * math.sqrt(top):
            return _LOWEST
        p = _pmf if high <= 20 else _interval
        return min(0.0, p(n, high) - p(top, high))
    if n < bottom:
        p = _pmf if low <= 170 else _interval
        return min(0.0, p(n, low) - p(bottom, low))
    return 0.0


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series from x + 8 on; off by less than 1e-12 of
    its value or 1e-12, whichever is more."""
    shift = reduce(lambda acc, i: acc * (x + i), range(1, 8), x)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


# ln n! of the whole numbers that exact masses ask for, correct to the last bit: a depth's
# weight may lie right on half a unit of what it is rounded to.
_LOG_FACTORIALS = [math.log(math.factorial(n)) for n in range(256)]


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers n >= 0."""
    return F.when(n < len(_LOG_FACTORIALS), F.get(F.array(*[F.lit(v) for v in _LOG_FACTORIALS]), n.cast("int"))).otherwise(log_gamma(n.cast("double") + 1))


# Nodes and weights of Gauss's rule on [-1/2, 1/2].
_NODES, _WEIGHTS = (v / 2 for v in np.polynomial.legendre.leggauss(8))


def log_interval(n: Column, mean: Column) -> Column:
    """ln of the normal probability of [n - 0.5, n + 0.5], mean and variance `mean`, not below
    ln 1e-100. By Gauss's rule, whose relative error is below 1e-10 for means of 20 on and
    depths within 21 deviations."""
    middle = -((n - mean) ** 2) / (2 * mean)
    # exp of what a node differs from the middle by.
    parts = [float(w) * F.exp(-(2 * (n - mean) * float(t) + float(t) ** 2) / (2 * mean)) for t, w in zip(_NODES, _WEIGHTS)]
    return F.greatest(F.lit(_LOWEST), middle + F.ln(reduce(lambda a, b: a + b, parts)) - 0.5 * F.ln(2 * math.pi * mean))


def band_ratio_of(n: Column, mean: Column) -> Column:
    """band_ratio as an expression of columns: it stays in generated code. n: whole numbers."""
    n = n.cast("double")
    low, high = mean / math.sqrt(2), mean * math.sqrt(2)
    top, bottom = F.ceil(high).cast("double"), F.floor(low).cast("double")
    above = n > top
    m, edge, limit = F.when(above, high).otherwise(low), F.when(above, top).otherwise(bottom), F.when(above, 20.0).otherwise(170.0)
    log_p = lambda x: F.when(m <= limit, x * F.ln(m) - m - log_factorial(x)).otherwise(log_interval(x, m))
    far = above & (n - top >= 20 * F.sqrt(top))
    outside = F.when(far, _LOWEST).otherwise(F.least(F.lit(0.0), log_p(n) - log_p(edge)))
    return F.when(above | (n < bottom), outside).otherwise(0.0)
