"""Tails of Student's t by the regularised incomplete beta function, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's method), all rows together."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if inside.any():
        p, q, y = a[inside], b[inside], x[inside]
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
        low = y < (p + 1) / (p + q + 2)
        direct = front * _fraction(np.where(low, p, q), np.where(low, q, p), np.where(low, y, 1 - y)) / np.where(low, p, q)
        out[inside] = np.where(low, direct, 1 - direct)
    return out


def p_of_r(r, n) -> np.ndarray:
    """Two-sided p of Pearson's r over n pairs; NaN under 3 pairs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    ok = (n > 2) & np.isfinite(r)
    out = np.full(r.shape, np.nan)
    if ok.any():
        out[ok] = incomplete_beta((n[ok] - 2) / 2, 0.5, 1 - np.clip(r[ok], -1, 1) ** 2)
    return out


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p as a column; null where it isn't defined. For tables of results: one batch of numbers to Python."""

    @F.pandas_udf("double")
    def p(a, b):
        import pandas as pd

        return pd.Series(p_of_r(a.to_numpy(float), b.to_numpy(float)))

    got = p(r.cast("double"), n.cast("double"))
    return F.when(F.isnan(got), None).otherwise(got)
