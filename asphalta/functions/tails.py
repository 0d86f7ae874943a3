"""Upper tails of the chi-square and Student distributions.

Spark has no such function.  They are needed on result frames of a few rows
(one per table or pair of columns), so a small Arrow UDF is enough.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


LARGE = 1e6


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    # Modified Lentz evaluation of the continued fraction.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            return scale * h
    raise ArithmeticError(f"no limit reached for Q({a}, {x})")


def beta_i(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); rest is 1 - x where it is known better."""
    rest = 1 - x if rest is None else rest
    if x <= 0 or rest <= 0:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, rest, x)
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * log_x + b * log_rest) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        for an in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + an * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + an / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"no limit reached for I_{x}({a}, {b})")


def pearson_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation r over n complete rows."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    if dof > LARGE:
        # Student's tail as the normal tail of Wallace's transform, whose error falls with dof squared;
        # the beta function would lose its digits to 1 - r * r and to log-gammas of large numbers.
        z = (8 * dof + 1) / (8 * dof + 3) * math.sqrt(-dof * math.log1p(-r * r))
        return math.erfc(z / math.sqrt(2))
    return beta_i(dof / 2, 0.5, 1 - r * r, r * r)


@F.pandas_udf(DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(s) or pd.isna(k) or k <= 0 else gamma_q(k / 2, s / 2)
         for s, k in zip(stat, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_tail(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) or pd.isna(k) else pearson_p(float(x), float(k))
         for x, k in zip(r, n)], dtype="float64")
