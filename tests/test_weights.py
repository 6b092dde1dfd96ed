"""Weighted distances and compositions against plain numpy, and the rows that are made of them."""

from math import sqrt

import numpy as np
import pytest

from locuspark.functions import posterior as P
from locuspark.operators import align, sequences, tally
from locuspark.plans import dist
from locuspark.sources import rows

CONFIG = dist.DistConfig(max_points=500)
BQS = "sample string, tid int, pos int, base string, qual int, strand int, ct long"
CALLS = [
    ("A", 0, 7, "A", 30, 0, 20), ("A", 0, 7, "A", 12, 1, 5), ("A", 0, 7, "A", 12, 0, 2), ("A", 0, 7, "C", 3, 1, 9), ("A", 0, 7, "N", 40, 1, 4),
    ("B", 0, 7, "G", 25, 0, 15), ("B", 0, 7, "T", 8, 1, 3), ("B", 0, 7, "G", 6, 1, 4),
]


def counted(sample, min_qual=5):
    return [sum(c[6] for c in CALLS if c[0] == sample and c[3] == b and c[4] >= min_qual) for b in "ACGT"]


def weights(x, terms, counts, config):
    out = np.zeros(len(x))
    for k, p in enumerate(x):
        for b, q, ct in terms:
            e = 10 ** (-q / 10)
            out[k] += ct * np.log(sum(p[j] * ((1 - e) if j == b else e / 3) for j in range(4)))
        out[k] -= sum((c - (config.prior if config.residual == "compat" else 0)) * np.log(max(v, 1e-300)) for c, v in zip(counts, p))
    return np.exp(out - out.max())


def quantile(values, w, q):
    total, before = w.sum(), 0.0
    for i in np.argsort(values, kind="stable"):
        if before >= q * total:
            return values[i]
        before += w[i]
    return values.max()


def points(counts, config):
    alpha = np.array(counts) + config.prior
    return P.dirichlet(P.generator(alpha), alpha, config.points)


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, BQS)


def states(spark, two, s2):
    row = ("A", s2, 0, 7, *counted("A"), *two)
    names = "s1 string, s2 string, tid int, pos int, " + ", ".join(f"{b}_{i} long" for i in (1, 2) for b in "acgt")
    return dist.pair_states(spark.createDataFrame([row], names), CONFIG)


def test_terms_leave_out_low_qualities_and_ambiguous_bases(calls):
    got = {r["sample"]: [tuple(t) for t in r["terms"]] for r in dist.quality_terms(calls, CONFIG).collect()}
    assert got == {"A": [(0, 12, 7), (0, 30, 20)], "B": [(2, 6, 4), (2, 25, 15), (3, 8, 3)]}


@pytest.mark.parametrize("residual", ["compat", "exact"])
def test_distances_against_brute_force(spark, calls, residual):
    config = dist.DistConfig(max_points=500, residual=residual)
    terms = dist.quality_terms(calls, config)
    for s2, two in (("B", counted("B")), ("REF", [0, 0, 1_000_000, 0])):
        found = states(spark, two, s2)
        row = found.first()
        order = list(row["order"])
        assert row["state"] == "changed" and [counted("A")[b] for b in order] == list(row["c1"])
        x, y = points(row["c1"], config), points(row["c2"], config)
        place = {b: i for i, b in enumerate(order)}
        w = weights(x, [(place[0], 12, 7), (place[0], 30, 20)], row["c1"], config)
        if s2 == "B":
            w = w * weights(y, [(place[2], 6, 4), (place[2], 25, 15), (place[3], 8, 3)], row["c2"], config)
        d = np.sqrt(((x - y) ** 2).sum(axis=1))
        got = dist.distance_quantiles(found, terms, config).first()
        assert [got[f"q_{i}"] for i in range(5)] == pytest.approx([quantile(d, w, q) / sqrt(2) for q in config.quantiles], abs=1e-12)


def test_compositions_against_brute_force(spark, calls):
    terms = dist.quality_terms(calls, CONFIG)
    counts = spark.createDataFrame([(s, 0, 7, *counted(s)) for s in "AB"], "sample string, tid int, pos int, a long, c long, g long, t long")
    where = spark.createDataFrame([("A", "B", 0, 7)], "s1 string, s2 string, tid int, pos int")
    got = {(r["sample"], r["base"]): r for r in dist.compositions(counts, terms, where, CONFIG).collect()}
    for s in "AB":
        x = points(counted(s), CONFIG)
        w = weights(x, [("ACGT".index(b), q, ct) for b, q, ct in {"A": [("A", 12, 7), ("A", 30, 20)], "B": [("G", 6, 4), ("G", 25, 15), ("T", 8, 3)]}[s]], counted(s), CONFIG)
        means = {b: (x[:, i] * w).sum() / w.sum() for i, b in enumerate("ACGT")}
        for i, b in enumerate("ACGT"):
            r = got[s, b]
            assert r["mean"] == pytest.approx(means[b]) and r["rank"] == sorted("ACGT", key=lambda k: (-means[k], k)).index(b)
            assert [r[f"q_{k}"] for k in range(5)] == pytest.approx([quantile(x[:, i], w, q) for q in CONFIG.quantiles], abs=1e-12)


def test_reference_tiles(spark):
    text = {0: "ACGT" * 30 + "NNac", 1: "G" * 7, 2: ""}
    contigs = spark.createDataFrame(list(text.items()), "tid int, ref string")
    tiles = sequences.tiles(contigs, 16)
    assert {(r["tid"], r["tile"]): r["seq"] for r in tiles.collect()} == {(t, i // 16): s[i : i + 16] for t, s in text.items() for i in range(0, len(s), 16)}
    spans = [(t, b, e) for t in range(4) for b in (0, 3, 15, 16, 40, 120) for e in (b, b + 1, b + 17, b + 70)]
    got = {(r["tid"], r["beg"], r["stop"]): r["seq"] for r in sequences.fetch(spark.createDataFrame(spans, "tid int, beg int, stop int"), tiles, 16).collect()}
    assert got == {(t, b, e): text[t][b:e] for t, b, e in spans if text.get(t, "")[b:e]}
    loci = spark.createDataFrame([(0, 0), (0, 122), (0, 200), (1, 6), (1, 7), (5, 0)], "tid int, pos int")
    assert {(r["tid"], r["pos"]): r["ref_base"] for r in sequences.with_reference(loci, tiles, 16).collect()} == {(0, 0): "A", (0, 122): "A", (0, 200): "N", (1, 6): "G", (1, 7): "N", (5, 0): "N"}


def test_indels_are_spelled_in_pileups_and_rows(spark):
    tiles = sequences.tiles(spark.createDataFrame([(0, "ACGTACGTAC")], "tid int, ref string"), 4)
    events = spark.createDataFrame(
        [("A", 0, 3, False, 2, None, 2), ("A", 0, 3, True, 1, "G", 1), ("B", 0, 3, True, 2, "TT", 3)], "sample string, tid int, pos int, is_ins boolean, len int, seq string, ct long"
    )
    spelled = tally.indel_sequence(events, tiles, 4)
    bqs = spark.createDataFrame([("A", 0, 3, "T", "T", 30, 1, 2), ("A", 0, 3, "T", "C", 2, 0, 1)], "sample string, tid int, pos int, ref_base string, base string, qual int, strand int, ct long")
    r = align.pileup_strings(bqs, spelled).first()
    assert (r["calls"], r["quals"], r["n_hi"], r["n_lo"], r["n_indel"]) == ("c..-2TA-2TA+1G", "#??", 2, 1, 3)
    pairs = spark.createDataFrame([("A", "B")], "s1 string, s2 string")
    matches = spark.createDataFrame([("A", "B", 0, 3, 5, 70)], "s1 string, s2 string, tid int, pos int, m1 long, m2 long")
    config = dist.DistConfig(max_points=500, min_dist=0.01)
    found = dist.indel_distances(align.indel_pairs(spelled, pairs), matches, config)
    contigs = spark.createDataFrame([(0, "chr1")], "tid int, name string")
    out = rows.indel_rows(found.selectExpr("*", "'T' as ref_base"), contigs, ["q_2"]).first()
    assert (out["counts1"], out["counts2"], out["events"]) == ("5,2,1,0", "70,0,0,3", "@,-TA,+G,+TT")
