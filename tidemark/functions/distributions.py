"""Tails and quantiles of the normal, t, chi-square and Kolmogorov laws.

Spark has no such SQL functions. They are only ever applied to finished test
statistics (a handful of rows), through small Arrow UDFs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _lentz(step) -> float:
    """Modified Lentz evaluation of a continued fraction given by step(n)->(a, b)."""
    b0 = step(0)[1]
    f = b0 if b0 != 0 else _TINY
    c, d = f, 0.0
    for n in range(1, 500):
        a, b = step(n)
        d = b + a * d
        d = 1.0 / (d if d != 0 else _TINY)
        c = b + a / c
        c = c if c != 0 else _TINY
        delta = c * d
        f *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def step(n):
        if n == 0:
            return 0.0, 1.0
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front += a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / (a * _lentz(step))


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_quantile(p: float, df: float) -> float:
    """Quantile by bisection on the upper tail."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    lo, hi = 0.0, 2.0
    while t_sf(hi, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_sf(mid, df) > 1.0 - p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square through the regularised incomplete gamma."""
    if x <= 0.0:
        return 1.0
    s, z = df / 2.0, x / 2.0
    front = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1.0:
        term = total = 1.0 / s
        n = s
        while term > total * 1e-17:
            n += 1.0
            term *= z / n
            total += term
        return max(0.0, 1.0 - front * total)

    def step(n):
        if n == 0:
            return 0.0, z + 1.0 - s
        return -n * (n - s), z + 2 * n + 1.0 - s

    return front / _lentz(step)


def kolmogorov_sf(x: float) -> float:
    """Limit law of sqrt(n)·D."""
    if x <= 0.0:
        return 1.0
    if x < 0.3:  # the theta-transformed series converges at once for small x
        k = np.arange(1, 6)
        cdf = math.sqrt(2 * math.pi) / x * np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)).sum()
        return float(1.0 - cdf)
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2.0 * (np.where(k % 2, 1.0, -1.0) * np.exp(-2.0 * k * k * x * x)).sum())))


def ks_two_sample_p(d: float, n1: int, n2: int, method: str = "limit") -> float:
    """Two-sided p-value, by one law at every sample size: ``limit`` (of
    Kolmogorov) or ``exact``, which counts lattice paths that stay below ``d``
    and takes n1 * (n1 + n2) steps."""
    if method not in ("limit", "exact"):
        raise ValueError("method is 'limit' or 'exact'")
    if n1 <= 0 or n2 <= 0:
        return float("nan")
    if d <= 0.0:
        return 1.0
    if method == "limit":
        return kolmogorov_sf(math.sqrt(n1 * n2 / (n1 + n2)) * d)
    # share of monotone paths (0,0)->(n1,n2) whose gap |i/n1 - j/n2| stays < d:
    # walk the n1+n2 draws in random order, tracking P(i of the first k are from sample 1)
    i = np.arange(n1 + 1)
    prob = np.zeros(n1 + 1)
    prob[0] = 1.0
    for k in range(1, n1 + n2 + 1):
        left = n1 + n2 - k + 1
        take1 = (n1 - i) / left
        take2 = np.clip(n2 - (k - 1 - i), 0, None) / left
        nxt = prob * take2
        nxt[1:] += prob[:-1] * take1[:-1]
        j = k - i
        outside = (j < 0) | (j > n2) | (np.abs(i / n1 - j / n2) >= d - 1e-12)
        nxt[outside] = 0.0
        prob = nxt
    return float(min(1.0, max(0.0, 1.0 - prob[n1])))


def _columnwise(fn):
    """A scalar function of finished statistics as an Arrow UDF; NULL in, NULL out."""

    @F.pandas_udf(DoubleType())
    def apply(args: pd.DataFrame) -> pd.Series:
        ok = args.notna().all(axis=1)
        return pd.Series(
            [fn(*row) if good else None for row, good in zip(args.itertuples(index=False), ok)],
            dtype="float64",
        )

    return lambda *cols: apply(F.struct(*cols))


chi2_sf_col = _columnwise(chi2_sf)
normal_two_sided_col = _columnwise(lambda z: min(1.0, 2.0 * normal_sf(abs(z))))
t_two_sided_col = _columnwise(lambda t, df: min(1.0, 2.0 * t_sf(abs(t), df)))
t_quantile_col = _columnwise(t_quantile)
ks_p_cols = {m: _columnwise(lambda d, n1, n2, m=m: ks_two_sample_p(d, int(n1), int(n2), m)) for m in ("limit", "exact")}
