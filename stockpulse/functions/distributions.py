"""Tail probabilities of test statistics as column expressions (F15): the two-sample
Kolmogorov-Smirnov statistic and chi-square. Meant for report rows (one per compared column), not
for fact rows: each evaluates a series of a few hundred terms inside the expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KOLMOGOROV_TERMS = 60
GAMMA_TERMS = 400          # enough for some thousand degrees of freedom
TINY = 1e-300


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """P(D >= d) of two samples of n and m rows, by the limiting distribution. Two series of the
    same function: one converges fast for large arguments, the other for small ones."""
    n, m = n.cast("double"), m.cast("double")
    x = F.sqrt(n * m / (n + m)) * d
    large = F.aggregate(_steps(KOLMOGOROV_TERMS), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(-2.0 * k * k * x * x)) * 2
    odd = lambda k: (2 * k - 1) * (2 * k - 1)
    small = 1 - F.sqrt(F.lit(2 * math.pi)) / x * F.aggregate(
        _steps(KOLMOGOROV_TERMS), F.lit(0.0), lambda acc, k: acc + F.exp(-odd(k) * F.lit(math.pi ** 2 / 8) / (x * x)))
    p = F.when(x <= 1e-6, F.lit(1.0)).when(x < 1, small).otherwise(large)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def log_gamma_half(twice: Column) -> Column:
    """ln Gamma(twice / 2) for a positive whole `twice`: a sum of logarithms down to 1 or 1/2."""
    low = F.when(twice % 2 == 0, 0.0).otherwise(math.log(math.pi) / 2)
    below = F.when(twice > 2, F.sequence(F.lit(2) - twice % 2, twice - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return low + F.aggregate(below, F.lit(0.0), lambda acc, k: acc + F.ln(k / F.lit(2.0)))


def chi_square_p(stat: Column, df: Column) -> Column:
    """P(X >= stat) of chi-square with `df` degrees of freedom: the regularised upper incomplete gamma
    function, by its power series below the mean and by a continued fraction above. Without a degree of
    freedom there is nothing to test: 1."""
    df = df.cast("int")
    a, x = df / F.lit(2.0), stat / 2
    front = F.exp(-x + a * F.ln(x) - log_gamma_half(df))
    # power series of the lower function: x^k / (a (a+1) ... (a+k))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    lower = F.aggregate(_steps(GAMMA_TERMS), start, lambda s, k: F.struct(
        (s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")))["sum"]
    # continued fraction of the upper function, evaluated from the front
    b0 = x + 1 - a
    off = lambda c: F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)
    begin = F.struct(F.lit(1 / TINY).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))

    def step(s, k):
        part, b = k * (a - k), b0 + 2 * k
        d = 1 / off(part * s["d"] + b)
        c = off(b + part / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))
    upper = F.aggregate(_steps(GAMMA_TERMS), begin, step)["h"]
    p = F.when((df < 1) | (stat <= 0), F.lit(1.0)).when(stat == float("inf"), F.lit(0.0)) \
        .when(x < a + 1, 1 - front * lower).otherwise(front * upper)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
