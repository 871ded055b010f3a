"""Statistics over short ordered series, as built-in Column expressions.

* Moments are taken from exact DECIMAL sums (n, sum x, sum x^2), so the population variance
  ``(n*Sxx - Sx^2) / n^2`` has no cancellation error and does not depend on summation order.
* Division is guarded (``try_divide``): a constant series gives NULL, never an ANSI error, and
  NULL compares as false (numpy's NaN behaviour).
* ``round_half_up`` rounds with plain IEEE operations (scale, add 0.5, floor), so every engine
  that evaluates the same expression gets the same double.
* The p < 0.05 test of a Pearson r with n points is |r| > rcrit(n). rcrit comes from the
  closed-form Student-t CDF for integer degrees of freedom, solved by bisection at import.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,4)"


def round_half_up(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def var_pop(n: Column, sx: Column, sxx: Column) -> Column:
    """Population variance from exact sums (decimal sx, sxx); NULL when n = 0."""
    numer = (n.cast("decimal(20,0)") * sxx.cast(WIDE) - sx.cast(WIDE) * sx.cast(WIDE)).cast(WIDE)
    return F.try_divide(numer.cast("double"), (n * n).cast("double"))


def std_pop(n: Column, sx: Column, sxx: Column) -> Column:
    return F.sqrt(var_pop(n, sx, sxx))


def mean(n: Column, sx: Column) -> Column:
    return F.try_divide(sx.cast("double"), n.cast("double"))


def pearson(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson r from exact sums; NULL when either side is constant."""
    cov = (n.cast("decimal(20,0)") * sab.cast(WIDE) - sa.cast(WIDE) * sb.cast(WIDE)).cast(WIDE)
    va = (n.cast("decimal(20,0)") * saa.cast(WIDE) - sa.cast(WIDE) * sa.cast(WIDE)).cast(WIDE)
    vb = (n.cast("decimal(20,0)") * sbb.cast(WIDE) - sb.cast(WIDE) * sb.cast(WIDE)).cast(WIDE)
    den = F.sqrt(va.cast("double") * vb.cast("double"))
    return F.when((va > 0) & (vb > 0), F.try_divide(cov.cast("double"), den))


def _t_abs_cdf(r: float, dof: int) -> float:
    """P(|T| <= t) for Student t with integer dof, where t = r*sqrt(dof/(1-r^2)) (theta = asin r)."""
    theta = math.asin(r)
    s, c = math.sin(theta), math.cos(theta)
    if dof % 2 == 1:
        if dof == 1:
            return 2 * theta / math.pi
        term, acc = c, c
        for k in range(1, (dof - 3) // 2 + 1):
            term *= c * c * (2 * k) / (2 * k + 1)
            acc += term
        return 2 / math.pi * (theta + s * acc)
    term, acc = 1.0, 1.0
    for k in range(1, (dof - 2) // 2 + 1):
        term *= c * c * (2 * k - 1) / (2 * k)
        acc += term
    return s * acc


def critical_r(n: int, alpha: float = 0.05) -> float:
    """Smallest |r| with two-sided p < alpha for a Pearson r (or regression slope) on n points."""
    dof = n - 2
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if 1 - _t_abs_cdf(mid, dof) > alpha:
            lo = mid
        else:
            hi = mid
    return hi


# Trend rule constants (fixed values): |r| > 0.7 and p < 0.05 with at least 6 points.
TREND_MIN_POINTS = 6
TREND_MIN_ABS_R = 0.7
# n for which rcrit(n) exceeds 0.7; from n = 9 on the 0.7 bound dominates.
RCRIT = {n: critical_r(n) for n in range(TREND_MIN_POINTS, 40) if critical_r(n) > TREND_MIN_ABS_R}


def trend_threshold(n: Column) -> Column:
    expr = F.lit(TREND_MIN_ABS_R)
    for k in sorted(RCRIT, reverse=True):
        expr = F.when(n == F.lit(k), F.lit(RCRIT[k])).otherwise(expr)
    return expr
