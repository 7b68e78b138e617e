"""The two-sided p-value of Pearson's r."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    far = inside & (x > (a + 1) / (a + b + 2))  # the other tail's fraction converges faster
    p, q, z = np.where(far, b, a), np.where(far, a, b), np.where(inside, np.where(far, 1 - x, x), 0.5)
    log_beta = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in zip(p.ravel(), q.ravel())]).reshape(p.shape)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + log_beta) / p
    c, d, out = np.ones(p.shape), np.zeros(p.shape), np.ones(p.shape)
    for i in range(400):
        m = i // 2
        if i == 0:
            term = np.ones(p.shape)
        elif i % 2 == 0:
            term = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            term = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + term * d
        d = 1 / np.where(d == 0, 1e-300, d)
        c = 1 + term / c
        c = np.where(c == 0, 1e-300, c)
        out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    value = front * (out - 1)
    return np.where(inside, np.where(far, 1 - value, value), np.clip(x, 0, 1))


def pearson_p(r: Column, n: Column) -> Column:
    """P(|T| >= |t|) for t = r sqrt((n - 2) / (1 - r^2)); NULL for fewer than 3 pairs."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        r, n = r.to_numpy(dtype=float), n.to_numpy(dtype=float)
        some = ~np.isnan(r) & (n >= 3)
        out = np.full(len(r), np.nan)
        out[some] = incomplete_beta((n[some] - 2) / 2, 0.5, np.maximum(0.0, 1 - r[some] ** 2))
        return pd.Series(out).astype("Float64").where(some, pd.NA)

    return p(r, n)
