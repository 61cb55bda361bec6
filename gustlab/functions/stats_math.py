"""Distribution tails for p-values (no SciPy in the image).

Regularized incomplete beta and gamma by continued fractions (Lentz's method), vectorised with NumPy and
exposed as pandas UDFs; they run on per-pair / per-series result rows, never on raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300
_ITERS = 300

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _betacf(a, b, x):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, _ITERS + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < _EPS):
            break
    return h


def betainc(a, b, x):
    """Regularized incomplete beta I_x(a, b), arrays broadcast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        lbt = _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        bt = np.exp(lbt)
        direct = xx < (aa + 1.0) / (aa + bb + 2.0)
        res = np.empty_like(xx)
        if direct.any():
            res[direct] = bt[direct] * _betacf(aa[direct], bb[direct], xx[direct]) / aa[direct]
        flip = ~direct
        if flip.any():
            res[flip] = 1.0 - bt[flip] * _betacf(bb[flip], aa[flip], 1.0 - xx[flip]) / bb[flip]
        out[mid] = res
    return out


def gammaincc(a, x):
    """Regularized upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    series = ok & (x > 0) & (x < a + 1.0)
    frac = ok & (x >= a + 1.0)
    if series.any():
        aa, xx = a[series], x[series]
        ap = aa.copy()
        s = 1.0 / aa
        d = s.copy()
        for _ in range(_ITERS * 3):
            ap = ap + 1.0
            d = d * xx / ap
            s = s + d
            if np.all(np.abs(d) < np.abs(s) * _EPS):
                break
        p = s * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
        out[series] = 1.0 - p
    if frac.any():
        aa, xx = a[frac], x[frac]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, _ITERS * 3):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < _EPS):
                break
        out[frac] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def cor_test_p(r, n):
    """Two-sided p of H0: rho = 0 from ``t = r sqrt((n-2)/(1-r^2))`` with n-2 df (R ``cor.test``)."""
    r = np.asarray(r, float)
    n = np.asarray(n, float)
    dof = n - 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        t2 = r * r * dof / np.maximum(1.0 - r * r, 0.0)
        x = dof / (dof + t2)
    x = np.where(np.abs(r) >= 1.0, 0.0, x)
    p = betainc(dof / 2.0, 0.5, x)
    return np.where(dof > 0, p, np.nan)


def chi2_sf(q, dof):
    return gammaincc(np.asarray(dof, float) / 2.0, np.asarray(q, float) / 2.0)


@F.pandas_udf(DoubleType())
def cor_test_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(cor_test_p(r.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def chi2_sf_udf(q: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(q.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan)))
