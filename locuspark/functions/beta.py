"""Beta distribution on arrays, in numpy: incomplete beta, its inverse, Jeffreys bounds."""

from __future__ import annotations

from math import lgamma

import numpy as np

TOLERANCE = 1e-10
_ln_gamma = np.vectorize(lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised I_x(a, b) by a continued fraction (modified Lentz), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (t > 0) & (t < 1)
    t_ = np.where(inside, t, 0.5)
    front = np.exp(_ln_gamma(p + q) - _ln_gamma(p) - _ln_gamma(q) + p * np.log(t_) + q * np.log1p(-t_)) / p
    tiny = 1e-300
    c = np.ones_like(t_)
    d = 1 - (p + q) * t_ / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for step in (m * (q - m) * t_ / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t_ / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            h = h * change
        if np.all(np.abs(change - 1) < 1e-14):
            break
    value = np.where(inside, front * h, np.where(t <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def beta_quantile(prob, a, b) -> np.ndarray:
    """The x with I_x(a, b) = prob to TOLERANCE: Newton steps, halving where one leaves the bracket."""
    prob, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (prob, a, b)))
    lo, hi = np.zeros(prob.shape), np.ones(prob.shape)
    x = np.clip(a / (a + b), 1e-12, 1 - 1e-12)
    norm = _ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b)
    todo = np.ones(prob.shape, bool)
    for _ in range(200):
        at = np.nonzero(todo)
        t = x[at]
        gap = incomplete_beta(a[at], b[at], t) - prob[at]
        lo[at], hi[at] = np.where(gap < 0, t, lo[at]), np.where(gap < 0, hi[at], t)
        slope = np.exp(norm[at] + (a[at] - 1) * np.log(t) + (b[at] - 1) * np.log1p(-t))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = t - gap / slope
        new = np.where((new > lo[at]) & (new < hi[at]), new, (lo[at] + hi[at]) / 2)
        x[at] = new
        todo[at] = (np.abs(new - t) > TOLERANCE) & (hi[at] - lo[at] > TOLERANCE)
        if not todo.any():
            break
    return x


def jeffreys_bounds(n, s, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of a proportion with s successes in n trials."""
    n, s = np.asarray(n, float), np.asarray(s, float)
    pairs, back = np.unique(np.stack([n.ravel(), s.ravel()]), axis=1, return_inverse=True)
    a, b = pairs[1] + 0.5, pairs[0] - pairs[1] + 0.5
    lo, hi = beta_quantile(1 - confidence, a, b), beta_quantile(confidence, a, b)
    back = back.reshape(n.shape)
    return lo[back], hi[back]


def beta_mean(n, s):
    return (s + 0.5) / (n + 0.5)
