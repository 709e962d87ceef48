"""Tail probabilities as column expressions and small scalar functions (there is no SciPy here)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_p(statistic: Column, n: Column, m: Column, terms: int = 50) -> Column:
    """Asymptotic p-value of a two-sample Kolmogorov-Smirnov statistic, by its series."""
    return kolmogorov_tail(F.sqrt(n * m / (n + m)) * statistic, terms)


def kolmogorov_tail(lam: Column, terms: int = 50) -> Column:
    """Tail of the Kolmogorov distribution, by its series."""
    term = lambda k: 2.0 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda total, k: total + term(k))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def polynomial(x: Column, highest_first: list[float]) -> Column:
    """A polynomial by Horner's rule."""
    out = F.lit(highest_first[0])
    for c in highest_first[1:]:
        out = out * x + c
    return out


def lower_quantile(near: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < near <= 0.5, to about 1e-9 of its value (rational approximation).

    The argument is read often: give a column that is there, not an expression.
    """
    # Coefficients of the approximation, highest power first; the tail begins at 0.02425.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
    q, tail = near - 0.5, F.sqrt(-2 * F.ln(near))
    return F.when(near < 0.02425, polynomial(tail, c) / polynomial(tail, d)).otherwise(q * polynomial(q * q, a) / polynomial(q * q, b))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1."""
    return lower_quantile(F.least(p, 1 - p)) * F.when(p > 0.5, -1.0).otherwise(1.0)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 1e-7 (rational approximation)."""
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the approximation, highest power first.
    c = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    p = F.lit(c[0])
    for k in c[1:]:
        p = p * t + k
    return t * F.exp(-x * x + p)


def chi2_sf_1(x: Column) -> Column:
    """Tail of the chi-square distribution with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the chi-square tail is ``gamma_q(df / 2, x / 2)``."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))
