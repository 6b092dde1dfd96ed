"""Logarithms of counts of arrangements, and small scalar helpers."""

from __future__ import annotations

from collections.abc import Callable
from math import lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_choose(n: float, k: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def log_multinomial(counts: list[float]) -> float:
    return lgamma(sum(counts) + 1) - sum(lgamma(c + 1) for c in counts)


def log_binomial(n: int, k: int, p: float) -> float:
    return log_choose(n, k) + k * log(p) + (n - k) * log(1 - p)


def log_flip_ratio(n: int, k: int, p: float) -> float:
    """Log of the odds of k against n - k successes."""
    return log_binomial(n, k, p) - log_binomial(n, n - k, p)


def search(f: Callable[[float], float], lo: float, hi: float, target: float, tolerance: float) -> float:
    """The x in [lo, hi] where a monotone f meets target."""
    rising = f(hi) >= f(lo)
    while hi - lo > tolerance:
        mid = (lo + hi) / 2
        if (f(mid) < target) == rising:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chunk_starts(n: int, chunks: int) -> list[int]:
    """Starts of n items dealt into chunks of like size."""
    return [n * i // chunks for i in range(chunks + 1)]


def strict_number(text: Column) -> Column:
    """The number a text is as a whole; anything else fails."""
    value = text.try_cast("double")
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(value)


def elapsed(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
