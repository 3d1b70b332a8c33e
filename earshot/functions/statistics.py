"""p-values as columns, from the regularised incomplete beta function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of 1/z, 1/z^3, ... in Stirling's series, and how far arguments are moved up before it is taken.
STIRLING, SHIFT = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188), 10
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """The logarithm of gamma at x > 0: Stirling's series at x + SHIFT, less the logarithms of x, x + 1, ..."""
    z = x + F.lit(float(SHIFT))
    series = F.lit(0.0)
    for k, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(z, F.lit(2.0 * k + 1))
    # one logarithm of the product, at most 1e300 for any x up to 1e29
    below = F.log(F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda product, k: product * (x + k)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - below


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """I_x(a, b), by the continued fraction on the side where it converges fast. rest: 1 - x where that is known better.

    The fraction is folded term by term over a sequence; about the root of the larger parameter in terms are enough."""
    rest = 1 - x if rest is None else rest
    other = x > (a + 1) / (a + b + 2)
    p, q, y, z = F.when(other, b).otherwise(a), F.when(other, a).otherwise(b), F.when(other, rest).otherwise(x), F.when(other, x).otherwise(rest)
    away = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    terms = F.sequence(F.lit(1), F.ceil(100 + 12 * F.sqrt(F.greatest(a, b))).cast("int"))
    first = 1 / away(1 - (p + q) * y / (p + 1))

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    def step(s: Column, j: Column) -> Column:
        k = term(j)
        c, d = away(1 + k / s["c"]), 1 / away(1 + k * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    begin = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
    fraction = F.aggregate(F.transform(terms, lambda j: j + 1), begin, step, lambda s: s["f"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(z)) / p
    inside = F.when(other, 1 - front * fraction).otherwise(front * fraction)
    return F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).otherwise(inside)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null without degrees of freedom."""
    n, square = df.cast("double"), t * t
    return F.when(df > 0, incomplete_beta(n / 2, F.lit(0.5), n / (n + square), square / (n + square)))


def spearman_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation over n pairs; null for two pairs or fewer."""
    t = rho * F.sqrt((n - 2) / (1 - rho * rho))
    return F.when((n > 2) & (F.abs(rho) >= 1), F.lit(0.0)).when(n > 2, t_p_value(t, n - 2))
