"""Distribution functions and quantiles (normal, Student t, F, chi-squared) without SciPy, as NumPy and as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LG = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.clip(np.where(turn, 1 - x, x), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LG(p + q) - _LG(p) - _LG(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for t in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    got = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(turn, 1 - got, got)


def gamma_inc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function by its series, or Legendre's fraction for large x."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.empty(a.shape)
    for i in np.ndindex(a.shape):
        s, v = float(a[i]), float(x[i])
        if v <= 0:
            out[i] = 0.0
        elif v < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > 1e-16 * abs(total):
                n += 1
                term *= v / n
                total += term
            out[i] = total * math.exp(-v + s * math.log(v) - math.lgamma(s))
        else:
            b, c = v + 1 - s, 1e300
            d = 1 / b
            h = d
            for k in range(1, 500):
                t = -k * (k - s)
                b += 2
                d = 1 / (t * d + b)
                c = b + t / c
                h *= d * c
            out[i] = 1 - h * math.exp(-v + s * math.log(v) - math.lgamma(s))
    return out


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def f_cdf(x: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    x, d1, d2 = (np.asarray(v, dtype=float) for v in (x, d1, d2))
    return np.where(x <= 0, 0.0, beta_inc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)))


def chi2_cdf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_inc(np.asarray(df, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(np.asarray(z, dtype=float))


def quantile(cdf, p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Inverse of a rising function by bisection to double precision."""
    p = np.asarray(p, dtype=float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(80):
        m = (a + b) / 2
        up = cdf(m) < p
        a, b = np.where(up, m, a), np.where(up, b, m)
    return (a + b) / 2


def t_quantile(p: Column, df: Column) -> Column:
    """Student quantile as a column; null in, null out."""

    @F.pandas_udf("double")
    def run(ps: pd.Series, dfs: pd.Series) -> pd.Series:
        ok = (ps.notna() & dfs.notna()).to_numpy()
        out = np.full(len(ps), np.nan)
        d = dfs.to_numpy()[ok]
        out[ok] = quantile(lambda m: t_cdf(m, d), ps.to_numpy()[ok], -1e4, 1e4)
        return pd.Series(out).where(ok)

    return run(p, df)


def t_survival(t: Column, df: Column) -> Column:
    """Two-sided p of a t value."""

    @F.pandas_udf("double")
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series(2 * (1 - t_cdf(ts.abs().to_numpy(), dfs.to_numpy())))

    return run(t, df)
