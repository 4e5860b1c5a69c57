"""Distribution functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9) of the gamma function.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x of at least 1/2."""
    z = x - 1
    series = F.lit(_LANCZOS[0]) + sum((F.lit(c) / (z + k) for k, c in enumerate(_LANCZOS) if k), F.lit(0.0))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def beta_fraction(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from its tail; converges for x under (a + 1) / (a + b + 2)."""

    def term(k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return 1 / F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda tail, k: 1 + term(k.cast("double")) / tail)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * beta_fraction(a, b, x) / a).otherwise(1 - front * beta_fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null without degrees of freedom."""
    df = df.cast("double")
    return F.when(df > 0, incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal deviate: Student's t far beyond any sample's degrees of freedom is not exact enough, so
    the complementary error function's continued fraction is used, and its series near zero."""
    x = F.abs(z) / math.sqrt(2)
    square = x * x
    tail = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda below, k: x + (k.cast("double") / 2) / below)
    far = F.exp(-square) / math.sqrt(math.pi) / tail
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = -s["term"] * square / k
        return F.struct(term.alias("term"), (s["total"] + term / (2 * k + 1)).alias("total"))

    near = 1 - 2 / math.sqrt(math.pi) * x * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda s, k: add(s, k.cast("double")))["total"]
    return F.when(x < 2, near).otherwise(far)
