"""Tails of the Student-t and F distributions as native columns.

Both are values of the regularised incomplete beta function, whose continued fraction is
evaluated from its last term by an ``aggregate`` over the term numbers: no Python worker, no
library.  Meant for result rows (one per fitted model), not for the data itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Terms of the continued fraction: enough for 1e-14 on the half of the interval where it is used.
TERMS = 300
_NEWTON = 8
# The coefficients of Lanczos' series for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_Z975 = 1.959963984540054


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of at least 1/2."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + i)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    def term(value: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        k = m - 1
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return 1 + odd / (1 + even / value)

    terms = F.transform(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), lambda m: m.cast("double"))
    return F.aggregate(terms, F.lit(1.0), term)


def _half(x: Column, a: Column, b: Column) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    return F.when(x > 0, front / _fraction(x, a, b)).otherwise(0.0)


def beta_inc(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function; the smaller side of the interval is evaluated."""
    return F.when(x > (a + 1) / (a + b + 2), 1 - _half(1 - x, b, a)).otherwise(_half(x, a, b))


def p_value(t: Column, freedom: Column) -> Column:
    """Two-sided tail of t; NULL without a statistic or degrees of freedom."""
    t, v = t.cast("double"), freedom.cast("double")
    inside = beta_inc(v / (v + t * t), v / 2, F.lit(0.5))
    return F.when((v > 0) & ~F.isnan(t) & (F.abs(t) < float("inf")), inside).when((v > 0) & (F.abs(t) == float("inf")), 0.0)


def f_tail(f: Column, above: Column, below: Column) -> Column:
    """Upper tail of F with the degrees of freedom above and below the line."""
    f, p, q = f.cast("double"), above.cast("double"), below.cast("double")
    return F.when((f >= 0) & (p > 0) & (q > 0), beta_inc(q / (q + p * f), q / 2, p / 2))


def t_975(freedom: Column) -> Column:
    """The upper quantile of 97.5 %: an expansion in the degrees of freedom, corrected by Newton's method on the tail.

    The tail is convex and the expansion begins below the quantile, so the steps close in on it from one side.
    """
    v, z = freedom.cast("double"), _Z975
    start = (F.lit(z) + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / v**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / v**3)
    scale = F.exp(log_gamma((v + 1) / 2) - log_gamma(v / 2)) / F.sqrt(v * math.pi)

    def step(t: Column, _: Column) -> Column:
        density = scale * F.pow(1 + t * t / v, -(v + 1) / 2)
        return t + (beta_inc(v / (v + t * t), v / 2, F.lit(0.5)) - 0.05) / (2 * density)

    return F.when(v >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), F.least(start, F.lit(12.0)), step))
