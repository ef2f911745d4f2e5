"""Statistics of rows and groups; p-values need numeric kernels that SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def fold_change(a: Column, b: Column) -> Column:
    """Signed ratio of two means; infinite where one of them is 0, the first test first."""
    return (
        F.when(a == 0, float("inf")).when(b == 0, float("-inf"))
        .when(a > b, a / b).otherwise(-b / a)
    )


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    return F.try_divide(m1 - m2, F.sqrt(v1 / n1 + v2 / n2))


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    a, b = v1 / n1, v2 / n2
    return F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))


def pooled_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Student's t under equal variances; n1 + n2 - 2 degrees of freedom."""
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2)))


def max_fold(a: Column, b: Column) -> Column:
    """The greater of two means over the other; 0 where both are 0, infinite where one is."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == 0, 0.0).when(low == 0, float("inf")).otherwise(high / low)


def quartiles(values: Column) -> Column:
    """Of sorted values those at the rounded quarters of their number; 0 for none. One value
    is all three, of two the middle one is their mean."""
    x = F.array_sort(values)
    n = F.size(x)
    at = lambda q: F.get(x, F.least(F.round(n * F.lit(q)).cast("int"), n - 1))
    return (
        F.when(n == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        .when(n == 2, F.array(F.get(x, F.lit(0)), (F.get(x, F.lit(0)) + F.get(x, F.lit(1))) / 2, F.get(x, F.lit(1))))
        .otherwise(F.array(at(0.25), at(0.5), at(0.75)))
    )


def minus_log10(p: Column) -> Column:
    return -F.log10(p)


def rescaled(x: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    return F.when(high == low, F.lit(new_low)).otherwise((x - low) / (high - low) * (new_high - new_low) + new_low)


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function above 0, by Lanczos' series."""
    x = np.asarray(x, float)
    # Fixed values of the series with g = 7 and nine terms.
    terms = (
        0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
        12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
    )
    # Below a half through the next number up.
    low = x < 0.5
    y = np.where(low, x + 1, x) - 1
    total = terms[0] + sum(c / (y + i) for i, c in enumerate(terms[1:], 1))
    w = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(w) - w + np.log(total) - np.where(low, np.log(np.where(low, x, 1.0)), 0.0)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    p, q, z = np.where(ok, p, 1.0), np.where(ok, q, 1.0), np.where(ok, z, 0.5)
    inner = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(inner) + q * np.log1p(-inner)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = np.where(z <= 0, 0.0, front * h)
    out[ok] = np.where(swap, 1 - value, value)[ok]
    return out


def student_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_p_values(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f = np.asarray(f, float)
    return incomplete_beta(np.asarray(df2, float) / 2, np.asarray(df1, float) / 2, df2 / (df2 + df1 * f))


def normal_p_values(z: np.ndarray) -> np.ndarray:
    """Two-sided p-values of a standard normal: its square is chi-square with one degree of
    freedom, whose incomplete gamma function is a series near 0 and a continued fraction
    further out."""
    x = np.asarray(z, float) ** 2 / 2
    safe = np.where(np.isfinite(x), x, 1.0)
    near, far = np.minimum(safe, 2.0), np.maximum(safe, 2.0)
    term, total = 2.0 * np.ones_like(near), 2.0 * np.ones_like(near)
    for k in range(1, 60):
        term = term * near / (k + 0.5)
        total = total + term
    series = 1 - total * np.exp(-near) * np.sqrt(near) / math.sqrt(math.pi)
    tiny = 1e-300
    b = far + 0.5
    c, d = np.full_like(far, 1 / tiny), 1 / b
    h = d.copy()
    for i in range(1, 200):
        a = -i * (i - 0.5)
        b = b + 2
        d = 1 / np.where(np.abs(a * d + b) < tiny, tiny, a * d + b)
        c = np.where(np.abs(b + a / c) < tiny, tiny, b + a / c)
        h = h * d * c
    fraction = h * np.exp(-far) * np.sqrt(far) / math.sqrt(math.pi)
    return np.where(np.isnan(x), np.nan, np.where(np.isinf(x), 0.0, np.where(safe < 2, series, fraction)))


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_p_values(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def anova_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_p_values(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-values of a standard normal."""
    return pd.Series(normal_p_values(z.to_numpy(float)))
