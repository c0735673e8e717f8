"""Student's t distribution.

Spark has no t distribution. Both tails together are a regularised incomplete beta function
(Abramowitz & Stegun 26.7.1, 26.5.8), the same for every number of degrees of freedom;
quantiles follow by bisection. The rows are conditions, so they are few; as interpreted
column expressions the thousands of steps of a quantile took seconds a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.arrow import once

# Steps of the continued fraction; 100 leave a relative error below 1e-9 up to 1e8 degrees of freedom.
FRACTION_STEPS = 100
# Squares of sizes in between are neither zero nor infinite.
LEAST, LARGEST = 1e-150, 1e150


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, FRACTION_STEPS + 1):
        at = a + 2 * m
        for term in (m * (b - m) * x / ((at - 1.0) * at), -(a + m) * (a + b + m) * x / (at * (at + 1.0))):
            c, d = 1.0 + term / c, 1.0 / (1.0 + term * d)
            value *= c * d
    return value


def tails(size: float, df: float) -> float:
    """P(|T| > size); NaN for NaN and below one degree of freedom."""
    if math.isnan(size) or not df >= 1:
        return math.nan
    if size < LEAST:
        return 1.0
    square = min(size, LARGEST) ** 2
    near, far, a, b = square / (df + square), df / (df + square), df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - a * math.log1p(square / df) + b * math.log(near))
    if far < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, far) / a
    return 1.0 - front * _fraction(b, a, near) / b


def quantile(df: float, level: float) -> float:
    """The t with P(|T| <= t) = ``level``, sought as s / (1 - s) with s from 0 to 1."""
    low, high = 0.0, 1.0
    for _ in range(52):
        mid = (low + high) / 2.0
        low, high = (mid, high) if tails(mid / (1.0 - mid), df) > 1.0 - level else (low, mid)
    return low / (1.0 - low)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom; null for null, NaN for NaN."""

    def probabilities(sizes: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([tails(s, d) for s, d in zip(sizes, dfs)], dtype=np.float64)

    # a NaN in a pandas result would come back as null
    found = once(F.pandas_udf(probabilities, "double"))(F.abs(t), df)
    return F.when(F.isnan(t), t).when(t.isNotNull() & df.isNotNull(), found)


def t_critical(df: Column, level: float = 0.95) -> Column:
    """The t with P(|T| <= t) = ``level``."""

    def quantiles(dfs: pd.Series) -> pd.Series:
        return pd.Series([quantile(d, level) for d in dfs], dtype=np.float64)

    return F.when(df.isNotNull(), once(F.pandas_udf(quantiles, "double"))(df))
