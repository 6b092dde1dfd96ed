"""Comparison of sample pairs at loci: states, distances, compositions, indel distances.

The costly steps run once for each distinct key (a pair of count tuples in canonical order),
not for each locus, and the results are joined back. Points are seeded by their parameters,
so equal counts give equal points, whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import posterior as P
from locuspark.functions.codes import nt4
from locuspark.operators import align

BASES = ["a", "c", "g", "t"]


@dataclass(frozen=True)
class DistConfig:
    """Parameters of the comparison; min_dist_given says that min_dist is on [0, 1] and is
    scaled by the square root of 2, while the default is not."""

    min_dist: float = 0.2
    min_dist_given: bool = False
    confidence: float = 0.99
    max_points: int = 10_000
    prior: float = 0.1
    indel_prior: float = 0.1
    min_qual: int = 5
    quantiles: tuple[float, ...] = (0.005, 0.05, 0.5, 0.95, 0.995)
    #: Exponents of the proposal in the weights: counts less prior ("compat") or counts ("exact").
    residual: str = "compat"

    def __post_init__(self):
        q = self.quantiles
        if not 0.8 <= self.confidence <= 0.999999:
            raise ValueError("confidence must be in [0.8, 0.999999]")
        if not 0 < self.threshold < 1:
            raise ValueError("minimum distance must be in (0, 1) after scaling")
        if not 1 <= len(q) <= 10 or list(q) != sorted(q) or q[0] < 0 or q[-1] > 1:
            raise ValueError("1 to 10 nondecreasing quantiles in [0, 1]")
        if self.residual not in ("compat", "exact"):
            raise ValueError("residual must be compat or exact")

    @property
    def threshold(self) -> float:
        return self.min_dist * (sqrt(2) if self.min_dist_given else 1)

    @property
    def points(self) -> int:
        return P.whole_steps(self.max_points)


def _spread(keys: DataFrame, *columns: str) -> DataFrame:
    """The distinct keys, dealt to a fixed number of tasks: few bytes, but much work each."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select(*columns).distinct().repartition(n, *columns)


def paired_keys(paired: DataFrame) -> DataFrame:
    """Adds c1 and c2, the two samples' counts in canonical order, and order, the bases (0 to 3) in it."""
    both = [[F.col(f"{b}_{i}") for b in BASES] for i in (1, 2)]
    k = align.canonical_pair(*both)
    return paired.withColumn("k_", k).withColumns({"c1": F.col("k_.c1"), "c2": F.col("k_.c2"), "order": align.canonical_order(*both)}).drop("k_")


def quality_terms(bqs: DataFrame, config: DistConfig) -> DataFrame:
    """terms of every sample and locus: (b, q, ct), the count of each base (0 to 3) at each quality.

    Ambiguous bases and qualities below min_qual have no part in the likelihood. A list has at
    most four times as many entries as there are qualities.
    """
    b = nt4(F.col("base"))
    counted = bqs.where((b < 4) & (F.col("qual") >= config.min_qual)).groupBy("sample", "tid", "pos", b.alias("b"), F.col("qual").alias("q"))
    counted = counted.agg(F.sum("ct").cast("long").alias("ct"))
    return counted.groupBy("sample", "tid", "pos").agg(F.sort_array(F.collect_list(F.struct("b", "q", "ct"))).alias("terms"))


TERMS = "array<struct<b:int,q:int,ct:bigint>>"


def _weights(points: np.ndarray, real: bool, terms, counts, config: DistConfig) -> np.ndarray:
    """Likelihood over proposal density at points, scaled to at most 1; 1 for the reference."""
    if not real:
        return np.ones(len(points))
    named = [(t["b"], 10.0 ** (-t["q"] / 10.0), t["ct"]) for t in terms]
    return P.scaled_weights(P.log_ratio(points, named, counts, config.prior, config.residual))


def key_states(keys: DataFrame, config: DistConfig) -> DataFrame:
    """state, n_trials, n_success, lo, hi for every distinct (c1, c2)."""

    def run(batches):
        for pdf in batches:
            both = [(np.array(a) + config.prior, np.array(b) + config.prior) for a, b in zip(pdf.c1, pdf.c2)]
            rows = P.compare_all(both, config.threshold, config.confidence, config.points)
            out = pd.DataFrame(rows, columns=["state", "n_trials", "n_success", "lo", "hi"])
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    return _spread(keys, "c1", "c2").mapInPandas(run, "c1 array<bigint>, c2 array<bigint>, state string, n_trials long, n_success long, lo double, hi double")


def pair_states(paired: DataFrame, config: DistConfig) -> DataFrame:
    keyed = paired_keys(paired)
    return keyed.join(key_states(keyed, config), ["c1", "c2"])


def distance_quantiles(states: DataFrame, terms: DataFrame, config: DistConfig) -> DataFrame:
    """Quantiles of the scaled distance for changed keys: s1, s2, tid, pos, q_0 .. q_n.

    terms: as of quality_terms(). Each point of a sample weighs the ratio of its likelihood
    under the base qualities to the density it was drawn from, and a pair of points the
    product; the reference weighs 1. Rows whose (1 - confidence) quantile does not exceed the
    threshold go. Work is done once for each distinct pair of counts and terms.
    """
    names = [f"q_{i}" for i in range(len(config.quantiles))]

    def run(batches):
        for pdf in batches:
            rows = []
            for a, b, t1, t2, r1, r2 in zip(pdf.c1, pdf.c2, pdf.t1, pdf.t2, pdf.r1, pdf.r2):
                x, y = (P.dirichlet(P.generator(np.array(c) + config.prior), np.array(c) + config.prior, config.points) for c in (a, b))
                d = np.sqrt(((x - y) ** 2).sum(axis=1))
                w = _weights(x, r1, t1, a, config) * _weights(y, r2, t2, b, config)
                test, *qs = P.weighted_quantiles(d, w, [1 - config.confidence, *config.quantiles])
                rows.append([test, *(q / sqrt(2) for q in qs)])
            out = pd.DataFrame(rows, columns=["test", *names])
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    def side(i: int) -> DataFrame:
        return terms.select(F.col("sample").alias(f"s{i}"), "tid", "pos", F.col("terms").alias(f"terms{i}"))

    def canonical(i: int) -> Column:
        named = F.transform(F.coalesce(f"terms{i}", F.array().cast(TERMS)), lambda t: F.struct((F.array_position("order", t["b"]).cast("int") - 1).alias("b"), t["q"].alias("q"), t["ct"].alias("ct")))
        return F.sort_array(named).alias(f"t{i}")

    changed = states.where(F.col("state") == P.CHANGED)
    changed = changed.join(side(1), ["s1", "tid", "pos"], "left").join(side(2), ["s2", "tid", "pos"], "left")
    real = [(F.col(f"s{i}") != align.REF).alias(f"r{i}") for i in (1, 2)]
    changed = changed.select("s1", "s2", "tid", "pos", "c1", "c2", canonical(1), canonical(2), *real)
    keys = ["c1", "c2", "t1", "t2", "r1", "r2"]
    kinds = f"c1 array<bigint>, c2 array<bigint>, t1 {TERMS}, t2 {TERMS}, r1 boolean, r2 boolean, test double, "
    found = _spread(changed, *keys).mapInPandas(run, kinds + ", ".join(f"{n} double" for n in names))
    return changed.join(found.where(F.col("test") > config.threshold), keys).select("s1", "s2", "tid", "pos", *names)


def compositions(counts: DataFrame, terms: DataFrame, distances: DataFrame, config: DistConfig) -> DataFrame:
    """base, rank, mean and quantiles of composition for samples that changed in any pair at a locus.

    Points weigh as in distance_quantiles().
    """
    both = distances.select("tid", "pos", F.explode(F.array("s1", "s2")).alias("sample")).distinct()
    rows = counts.join(both, ["sample", "tid", "pos"], "left_semi").join(terms, ["sample", "tid", "pos"], "left")
    rows = rows.select("sample", "tid", "pos", F.array(*BASES).alias("c"), F.coalesce("terms", F.array().cast(TERMS)).alias("t"))
    names = [f"q_{i}" for i in range(len(config.quantiles))]

    def run(batches):
        for pdf in batches:
            rows = []
            for c, t in zip(pdf.c, pdf.t):
                alpha = np.array(c) + config.prior
                x = P.dirichlet(P.generator(alpha), alpha, config.points)
                w = _weights(x, True, t, c, config)
                for i, base in enumerate("ACGT"):
                    rows.append([list(c), t, base, float((x[:, i] * w).sum() / w.sum()), *P.weighted_quantiles(x[:, i], w, config.quantiles)])
            yield pd.DataFrame(rows, columns=["c", "t", "base", "mean", *names])

    kinds = f"c array<bigint>, t {TERMS}, base string, mean double, " + ", ".join(f"{n} double" for n in names)
    found = _spread(rows, "c", "t").mapInPandas(run, kinds)
    return align.rank_of_means(rows.join(found, ["c", "t"]).drop("c", "t"), "sample", "tid", "pos")


def indel_distances(events: DataFrame, matches: DataFrame, config: DistConfig) -> DataFrame:
    """Quantiles of the scaled distance between two samples' event frequencies at a locus.

    events: s1, s2, tid, pos, is_ins, len, seq, ct1, ct2; matches: s1, s2, tid, pos, m1, m2, the
    reads that match there. A match is one more event if either sample has any. seq holds the
    letters of deletions too (see tally.indel_sequence). counts1 and counts2 begin with the
    matches, as events does with @.
    """
    event = F.struct("is_ins", "len", "seq", "ct1", "ct2")
    keys = ["s1", "s2", "tid", "pos"]
    grouped = events.groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("e")).join(matches, keys, "left")
    extra = lambda c: F.when(F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0)) > 0, F.array(F.coalesce(c, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    names = [f"q_{i}" for i in range(len(config.quantiles))]
    rows = grouped.select(
        *keys,
        F.concat(F.col("e.ct1"), extra("m1")).alias("c1"), F.concat(F.col("e.ct2"), extra("m2")).alias("c2"),
        *[F.array_join(F.concat(F.array(F.coalesce(f"m{i}", F.lit(0)).cast("long")), F.col(f"e.ct{i}")).cast("array<string>"), ",").alias(f"counts{i}") for i in (1, 2)],
        F.concat(F.lit("@,"), F.array_join(F.transform("e", lambda x: F.concat(F.when(x["is_ins"], "+").otherwise("-"), x["seq"])), ",")).alias("events"),
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for a, b in zip(pdf.c1, pdf.c2):
                x, y = (P.dirichlet(P.generator(np.array(c) + config.indel_prior), np.array(c) + config.indel_prior, config.points) for c in (a, b))
                d = ((x - y) ** 2).sum(axis=1)
                rows.append(np.sqrt(P.rank_quantiles(d, [1 - config.confidence, *config.quantiles])).tolist())
            out = pd.DataFrame([[r[0], *(q / sqrt(2) for q in r[1:])] for r in rows], columns=["test", *names])
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    found = _spread(rows, "c1", "c2").mapInPandas(run, "c1 array<bigint>, c2 array<bigint>, test double, " + ", ".join(f"{n} double" for n in names))
    return rows.join(found.where(F.col("test") >= config.threshold), ["c1", "c2"]).drop("c1", "c2", "test")


def pair_summary(states: DataFrame, distances: DataFrame) -> DataFrame:
    """Per pair: total, cacheable, cache_was_set, confirmed_changed, and the five states."""
    kinds = [P.UNCHANGED, P.AMBIGUOUS, P.CHANGED, P.AMBIGUOUS_OR_CHANGED, P.AMBIGUOUS_OR_UNCHANGED]
    zero = F.lit(0).cast("long")
    totals = states.groupBy("s1", "s2").agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == k).alias(k) for k in kinds])
    sure = distances.groupBy("s1", "s2").agg(F.count("*").alias("confirmed_changed"))
    return totals.join(sure, ["s1", "s2"], "left").select(
        "s1", "s2", "total", zero.alias("cacheable"), zero.alias("cache_was_set"), F.coalesce("confirmed_changed", zero).alias("confirmed_changed"), *kinds
    )
