"""Quantiles and tails of t, chi-square, F and normal in numpy (G2); Spark runs them on distinct degrees of freedom."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0) | (z >= 1), 0.0, front)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(abs(d * c - 1) < 1e-15):
            break
    out = front * h
    return np.where(swap, 1 - out, out)


def gamma_inc(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    low = x < a + 1
    with np.errstate(all="ignore"):
        scale = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(a))
        u = np.where(low, np.maximum(x, 0), 0.0)
        term = 1 / a
        total = term.copy()
        for n in range(1, 5000):
            term = term * u / (a + n)
            total = total + term
            if np.all(term < 1e-17 * total):
                break
        v = np.where(low, a + 2, x)
        b = v + 1 - a
        c, d = np.full_like(v, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 5000):
            step = -n * (n - a)
            b = b + 2
            d = 1 / (step * d + b)
            c = b + step / c
            h = h * c * d
            if np.all(abs(c * d - 1) < 1e-15):
                break
    return np.where(x <= 0, 0.0, np.where(low, np.minimum(1.0, total * scale), 1 - h * scale))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_two_sided(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    low = beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))
    return np.minimum(1.0, 2 * np.minimum(low, 1 - low))


def normal_cdf(z) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(z)


def _solve(cdf, p, low, high) -> np.ndarray:
    low, high = np.full(np.shape(p), low, float), np.full(np.shape(p), high, float)
    for _ in range(200):
        mid = (low + high) / 2
        below = cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def t_quantile(p, df) -> np.ndarray:
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = np.minimum(p, 1 - p)
    return np.sign(p - 0.5) * _solve(lambda t: 1 - t_two_sided(t, df) / 2, 1 - tail, 0.0, 1e4)


def chi2_quantile(p, df) -> np.ndarray:
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    return _solve(lambda x: gamma_inc(df / 2, x / 2), p, 0.0, float(np.max(df) * 20 + 200))


def normal_quantile(p) -> np.ndarray:
    return _solve(normal_cdf, np.asarray(p, float), -40.0, 40.0)
