"""Generated data: base calls drawn from compositions, and point pairs at a given distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions.codes import error_probability


def uniform(seed: int, *keys: str | Column) -> Column:
    """In [0, 1), the same for the same keys and seed on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def draw_bases(loci: DataFrame, priors: list[tuple[float, float, float, float, float]], depth: int, qual: int, seed: int = 1) -> DataFrame:
    """tid, pos, i, base, qual: `depth` calls a locus from a composition drawn by weight.

    priors: fractions of A, C, G and T, and a weight. A call is another base with the error
    probability of its quality.
    """
    total, below = sum(p[4] for p in priors), 0.0
    u, pick = uniform(seed, "tid", "pos"), None
    for *fractions, weight in priors:
        below += weight / total
        chosen = F.array(*[F.lit(float(x)) for x in fractions])
        pick = F.when(u < below, chosen) if pick is None else pick.when(u < below, chosen)
    pick = pick.otherwise(F.array(*[F.lit(float(x)) for x in priors[-1][:4]]))
    calls = loci.withColumn("p", pick).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    u = uniform(seed + 1, "tid", "pos", "i")
    p = F.col("p")
    true = F.when(u < p[0], 0).when(u < p[0] + p[1], 1).when(u < p[0] + p[1] + p[2], 2).otherwise(3)
    wrong = uniform(seed + 2, "tid", "pos", "i") < error_probability(F.lit(float(qual)))
    shift = F.when(wrong, 1 + F.floor(uniform(seed + 3, "tid", "pos", "i") * 3)).otherwise(0)
    return calls.select("tid", "pos", "i", F.substr(F.lit("ACGT"), ((true + shift) % 4 + 1).cast("int"), F.lit(1)).alias("base"), F.lit(qual).alias("qual"))


def points_at_distance(n: int, distance: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of points on the 4-simplex at a Euclidean distance, by rejection."""
    rng, out = np.random.default_rng(seed), []
    plane = np.linalg.qr(np.column_stack([np.ones(4), np.eye(4)[:, :3]]))[0][:, 1:]
    while len(out) < n:
        a = rng.dirichlet(np.ones(4), n)
        v = rng.standard_normal((n, 3))
        b = a + distance * (v / np.linalg.norm(v, axis=1, keepdims=True)) @ plane.T
        out += [(x, y) for x, y in zip(a, b) if (y >= 0).all()]
    return np.array([x for x, _ in out[:n]]), np.array([y for _, y in out[:n]])
