"""Beta distribution function and its inverse as Arrow UDFs.

Spark has neither.  Each row is one fitted distribution, so the UDFs see
(series, Year) pairs, never samples.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_cdf(x, a, b):
    """Regularised incomplete beta function of arrays that broadcast together."""
    x, a, b = (np.asarray(t, dtype=float) for t in (x, a, b))
    log_beta = _lgamma(a) + _lgamma(b) - _lgamma(a + b)  # once for each (a, b)
    x, a, b, log_beta = np.broadcast_arrays(x, a, b, log_beta)
    # The continued fraction converges fast below the mean; use symmetry above.
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = p * np.log(z) + q * np.log1p(-z) - log_beta - np.log(p)
        tail = np.exp(log_front) * _fraction(z, p, q)
    tail = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, tail))
    return np.clip(np.where(swap, 1 - tail, tail), 0.0, 1.0)


def _fraction(x, a, b, limit=20_000, accuracy=8e-15):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def away(t):
        return np.where(np.abs(t) < tiny, tiny, t)

    c = np.ones_like(x)
    d = 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, limit):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / away(1 + term * d)
            c = away(1 + term / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < accuracy):
            return h
    raise ArithmeticError(f"the incomplete beta function did not converge in {limit} steps")


def beta_quantile(p, a, b):
    """Inverse of ``beta_cdf`` in ``x``, elementwise: Newton steps within a bracket.

    A step that leaves the bracket, or after which the function is not at least
    halved, gives way to the middle of the bracket.  What has settled is not
    evaluated again.
    """
    p, a, b = np.broadcast_arrays(*(np.asarray(t, dtype=float) for t in (p, a, b)))
    shape = p.shape
    p, a, b = (np.ravel(t) for t in (p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    x = a / (a + b)
    off = np.full_like(p, np.inf)
    log_beta = _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    todo = np.arange(p.size)
    for _ in range(200):
        if not len(todo):
            break
        own, pa, pb = x[todo], a[todo], b[todo]
        f = beta_cdf(own, pa, pb) - p[todo]
        left, right = np.where(f < 0, own, low[todo]), np.where(f < 0, high[todo], own)
        low[todo], high[todo] = left, right
        middle = (left + right) / 2
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            density = np.exp((pa - 1) * np.log(own) + (pb - 1) * np.log1p(-own) - log_beta[todo])
            step = own - f / density
        good = np.isfinite(step) & (step > left) & (step < right) & (np.abs(f) <= off[todo] / 2)
        off[todo] = np.abs(f)
        new = np.where(good, step, middle)
        x[todo] = np.where(f == 0, own, new)
        settled = (f == 0) | (np.abs(new - own) <= 2e-15 * own) | (right - left <= 2.0**-60)
        todo = todo[~settled]
    return x.reshape(shape)[()]


def cdf_at_midpoints(k: int):
    """UDF ``(a, b) -> k`` values of the CDF at the middle of equal bins."""
    mid = (np.arange(k) + 0.5) / k

    @F.pandas_udf("array<double>")
    def cdf(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        fitted = np.flatnonzero(a.notna() & b.notna())
        if len(fitted):  # the block as one matrix
            values = beta_cdf(mid, a.to_numpy()[fitted, None], b.to_numpy()[fitted, None])
            out.iloc[fitted] = pd.Series(list(values), index=fitted)
        return out

    return cdf


def quantile_of(p: float):
    """UDF ``(a, b) ->`` quantile of the fitted distribution."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index)
        fitted = a.notna() & b.notna()
        if fitted.any():
            out[fitted] = beta_quantile(p, a[fitted].to_numpy(), b[fitted].to_numpy())
        return out.astype(object).where(fitted, None)

    return quantile
