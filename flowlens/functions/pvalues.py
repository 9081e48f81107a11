"""Tail probabilities Spark SQL has no function for, as Arrow UDFs.

They run on summary rows (one per feature), except the normal log-CDF, which
runs once per distinct value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _chi2_tail(x: float, df: int) -> float:
    """P(X > x) for an integer number of degrees of freedom."""
    if df < 1 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        steps = [1.5 + i for i in range((df - 1) // 2)]
    else:
        total, term = 0.0, math.exp(-half)
        steps = [1.0 + i for i in range(df // 2)]
    for s in steps:
        total += term
        term *= half / s
    return min(total, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    start = 1 - (a + b) * x / (a + 1)
    d = 1 / (start if abs(start) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _f_tail(f: float, d1: float, d2: float) -> float:
    if math.isnan(f):
        return math.nan
    return _incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_chi2_tail(a, int(b)) for a, b in zip(x, df)])


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([_f_tail(a, b, c) for a, b, c in zip(f, d1, d2)])


_erfc = np.vectorize(math.erfc, otypes=[float])


def _log_cdf(z: np.ndarray) -> np.ndarray:
    """log of the standard normal CDF, by its asymptotic series far in the left tail."""
    far = z < -30
    out = np.empty_like(z)
    out[~far] = np.log(_erfc(-z[~far] / math.sqrt(2)) / 2)
    t = z[far]
    out[far] = -t * t / 2 - np.log(-t) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / (t * t))
    return out


@F.pandas_udf(DoubleType())
def anderson_term(z: pd.Series, c: pd.Series, before: pd.Series, n: pd.Series) -> pd.Series:
    """Contribution of ``c`` equal values with ``before`` smaller ones among ``n``."""
    zs = z.to_numpy(dtype=float)
    cs, bs, ns = (s.to_numpy(dtype=float) for s in (c, before, n))
    lower = cs * (2 * bs + cs)
    upper = cs * (2 * (ns - bs) - cs)
    return pd.Series(lower * _log_cdf(zs) + upper * _log_cdf(-zs))
