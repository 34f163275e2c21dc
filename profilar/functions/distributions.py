"""Tail probabilities and quantiles for result tables.

Array functions for the few rows of a result, and their column forms. The
incomplete beta and gamma integrals use Lentz continued fractions and power
series from the standard numerical literature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _each(fn, values):
    values = np.asarray(values, float)
    return np.array([fn(v) for v in values.ravel()]).reshape(values.shape)


def _lgamma(values):
    return _each(math.lgamma, values)


def _erfc(values):
    return _each(math.erfc, values)


def _beta_fraction(a, b, x):
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta integral I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    a, b, x = a.astype(float), b.astype(float), np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb)
                       + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        out = np.where(xx <= 0, 0.0, front * _beta_fraction(aa, bb, xx))
    return np.where(flip, 1.0 - out, out)


def gamma_upper(s, x):
    """Regularised upper incomplete gamma integral Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.empty(s.shape)
    for i in np.ndindex(s.shape):
        out[i] = _gamma_upper_one(float(s[i]), float(x[i]))
    return out


def _gamma_upper_one(s, x):
    if math.isnan(x) or math.isnan(s):
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1 - s
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, df1, df2):
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * np.maximum(f, 0.0)))


def chi2_upper(q, df):
    return gamma_upper(np.asarray(df, float) / 2.0, np.asarray(q, float) / 2.0)


def normal_quantile(p):
    """Inverse normal by bisection of the tail function."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(200):
        mid = (low + high) / 2
        below = 0.5 * _erfc(-mid / math.sqrt(2.0)) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def t_quantile(p, df):
    """Inverse Student t for p in (0.5, 1), by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros(p.shape), np.full(p.shape, 1e7)
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - t_two_sided(mid, df) / 2 < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


Z_95 = 1.959963984540054


def _column(fn):
    @F.pandas_udf("double")
    def call(*args: pd.Series) -> pd.Series:
        values = [a.to_numpy(dtype=float, na_value=np.nan) for a in args]
        good = np.all([~np.isnan(v) for v in values], axis=0)
        out = np.full(len(args[0]), np.nan)
        if good.any():
            out[good] = fn(*[v[good] for v in values])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return call


def p_normal(z) -> Column:
    return _column(normal_two_sided)(z)


def p_t(t, df) -> Column:
    return _column(t_two_sided)(t, df)


def p_f(f, df1, df2) -> Column:
    return _column(f_upper)(f, df1, df2)


def p_chi2(q, df) -> Column:
    return _column(chi2_upper)(q, df)


# Coefficients of Acklam's published rational approximation of the
# normal quantile (numerators a, c; denominators b, d), good to 1e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
      3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile_column(p: str) -> Column:
    """Normal quantile as a built-in expression, for whole columns."""
    p = F.col(p)
    r = (p - 0.5) * (p - 0.5)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < _TAIL, _polynomial(_C, low) / _polynomial(_D, low))
        .when(p > 1 - _TAIL, -_polynomial(_C, high) / _polynomial(_D, high))
        .otherwise((p - 0.5) * _polynomial(_A, r) / _polynomial(_B, r))
    )
