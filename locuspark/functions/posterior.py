"""Dirichlet points, and the sequential comparison of two Dirichlets."""

from __future__ import annotations

import numpy as np
import xxhash

from locuspark.functions.beta import jeffreys_bounds

STEP = 32
CHANGED, AMBIGUOUS_OR_CHANGED, AMBIGUOUS, AMBIGUOUS_OR_UNCHANGED, UNCHANGED = (
    "changed", "ambiguous_or_changed", "ambiguous", "ambiguous_or_unchanged", "unchanged",
)


def whole_steps(points: int) -> int:
    """The number of points, up to the next multiple of STEP above it."""
    return points + STEP - points % STEP


def generator(alpha) -> np.random.Generator:
    """A generator that the parameters seed: equal parameters give equal points anywhere."""
    return np.random.Generator(np.random.Philox(xxhash.xxh64_intdigest(np.asarray(alpha, "<f8").tobytes())))


def dirichlet(rng: np.random.Generator, alpha, n: int) -> np.ndarray:
    g = rng.standard_gamma(np.asarray(alpha, float), size=(n, len(alpha)))
    total = g.sum(axis=1, keepdims=True)
    return np.where(total > 0, g / np.where(total > 0, total, 1), 1 / len(alpha))


def tags(bound: np.ndarray, confidence: float) -> np.ndarray:
    """2 unchanged, 1 ambiguous, 0 changed."""
    return np.where(confidence < bound, 2, np.where(1 - confidence < bound, 1, 0))


def state(lo: int, hi: int) -> str:
    if lo > hi:
        raise ValueError("bounds cross")
    if lo == hi:
        return (CHANGED, AMBIGUOUS, UNCHANGED)[lo]
    return AMBIGUOUS_OR_CHANGED if lo == 0 else AMBIGUOUS_OR_UNCHANGED


_tables: dict[tuple[int, float], np.ndarray] = {}


def step_bounds(trials: np.ndarray, wins: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """jeffreys_bounds() with the bounds met before kept, a table for each number of trials."""
    rows = []
    for n in trials.tolist():
        if (n, confidence) not in _tables:
            _tables[n, confidence] = np.full((n + 1, 2), np.nan)
        rows.append(_tables[n, confidence])
    missing = [i for i, (row, s) in enumerate(zip(rows, wins.tolist())) if np.isnan(row[s, 0])]
    if missing:
        lo, hi = jeffreys_bounds(trials[missing], wins[missing], confidence)
        for i, a, b in zip(missing, lo, hi):
            rows[i][wins[i]] = a, b
    both = np.array([row[s] for row, s in zip(rows, wins.tolist())])
    return both[:, 0], both[:, 1]


def compare_all(pairs, min_dist: float, confidence: float, max_points: int, block: int = 16) -> list[tuple[str, int, int, float, float]]:
    """state, trials, successes, lower and upper bound for each pair of parameter tuples.

    A success is a pair of points closer than min_dist. Bounds are checked every STEP points
    until the interval is narrow, or narrower where it leaves a change possible. Points come
    `block` steps at a time, and the bounds of all pairs still open are found together.
    """
    loose, tight = 1 - confidence, 0.2 * (1 - confidence)
    makers = [(generator(a), generator(b)) for a, b in pairs]
    now = [(0, 0, 0.0, 1.0)] * len(makers)
    open_ = list(range(len(makers)))
    n = 0
    while open_ and n < max_points:
        count = min(block * STEP, max_points - n)
        trials = n + STEP * np.arange(1, count // STEP + 1)
        wins = []
        for i in open_:
            (one, two), (rng1, rng2) = pairs[i], makers[i]
            near = ((dirichlet(rng1, one, count) - dirichlet(rng2, two, count)) ** 2).sum(axis=1) < min_dist**2
            wins.append(now[i][1] + np.cumsum(near.reshape(-1, STEP).sum(axis=1)))
        low, high = (x.reshape(len(open_), -1) for x in step_bounds(np.tile(trials, len(open_)), np.concatenate(wins), confidence))
        done = high - low <= np.where(tags(low, confidence) == 0, tight, loose)
        still = []
        for k, i in enumerate(open_):
            at = int(done[k].argmax()) if done[k].any() else len(trials) - 1
            now[i] = (int(trials[at]), int(wins[k][at]), float(low[k][at]), float(high[k][at]))
            if not done[k].any():
                still.append(i)
        open_, n = still, n + count
    return [(state(*(int(t) for t in tags(np.array([lo, hi]), confidence))), n, s, lo, hi) for n, s, lo, hi in now]


def rank_quantiles(values: np.ndarray, quantiles) -> list[float]:
    """The element of rank round(q n); 0.0 where that is n."""
    ordered, n = np.sort(values), len(values)
    ranks = [int(np.floor(q * n + 0.5)) for q in quantiles]
    return [float(ordered[r]) if r < n else 0.0 for r in ranks]


def weighted_quantiles(values: np.ndarray, weights: np.ndarray, quantiles) -> list[float]:
    """The first value whose preceding weight reaches q of the whole; the last if none does."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    before = np.concatenate(([0.0], np.cumsum(w)[:-1]))
    at = np.searchsorted(before, np.asarray(quantiles) * w.sum(), side="left")
    return [float(v[min(i, len(v) - 1)]) for i in at]


def log_ratio(points: np.ndarray, terms, counts, prior: float, residual: str = "compat") -> np.ndarray:
    """Log of likelihood over proposal density at points.

    terms: (base index, error probability, count). The proposal's exponents are counts - prior
    ("compat") or counts ("exact").
    """
    out = np.zeros(len(points))
    for base, error, ct in terms:
        p = np.full(points.shape[1], error / 3)
        p[base] = 1 - error
        out += ct * np.log(points @ p)
    exponent = np.asarray(counts, float) - (prior if residual == "compat" else 0.0)
    return out - (np.log(np.maximum(points, 1e-300)) * exponent).sum(axis=1)


def scaled_weights(logs: np.ndarray) -> np.ndarray:
    return np.exp(logs - logs.max())
