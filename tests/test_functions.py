"""Numerical routines against analytic facts, and micro fixtures of the operators."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.functions import beta, codes
from locuspark.functions import posterior as P
from locuspark.operators import align, filters, points, regions, simulate, tally
from locuspark.plans import dist, extra_queries, value_queries
from locuspark.plans.dist import DistConfig
from locuspark.sources import formats


def test_jeffreys_bounds_are_symmetric_and_monotone():
    n = np.full(33, 32)
    s = np.arange(33)
    lo, hi = beta.jeffreys_bounds(n, s, 0.99)
    assert np.allclose(lo, 1 - hi[::-1], atol=1e-8)
    assert (lo < hi).all() and (np.diff(lo) > 0).all() and (np.diff(hi) > 0).all()
    assert np.allclose(beta.incomplete_beta(s + 0.5, 32.5 - s, lo), 0.01, atol=1e-7)


def test_incomplete_beta_known_values():
    x = np.linspace(0.05, 0.95, 7)
    assert np.allclose(beta.incomplete_beta(1, 1, x), x)
    assert np.allclose(beta.incomplete_beta(2, 1, x), x**2)
    assert np.allclose(beta.incomplete_beta(1, 3, x), 1 - (1 - x) ** 3)


def test_dirichlet_marginals_are_beta():
    alpha = np.array([2.0, 3.0, 0.5, 1.5])
    x = P.dirichlet(P.generator(alpha), alpha, 20000)
    assert np.allclose(x.sum(axis=1), 1)
    for i, a in enumerate(alpha):
        u = np.sort(beta.incomplete_beta(a, alpha.sum() - a, x[:, i]))
        assert np.abs(u - np.arange(1, 20001) / 20000).max() < 0.02


def test_equal_counts_are_unchanged_and_opposite_ones_changed():
    same, other = np.array([50.1, 0.1, 0.1, 0.1]), np.array([0.1, 50.1, 0.1, 0.1])
    found = P.compare_all([(same, same), (same, other)], 0.2, 0.99, 10016)
    assert found[0][0] == "unchanged" and found[1][0] == "changed"
    assert P.compare_all([(same, other)], 0.2, 0.99, 10016)[0] == found[1]


def test_whole_steps():
    assert (P.whole_steps(10000), P.whole_steps(32)) == (10016, 64)


def test_quantiles():
    v = np.random.default_rng(1).permutation(1000).astype(float)
    assert P.rank_quantiles(v, [0.0, 0.5, 1.0]) == [0.0, 500.0, 0.0]
    assert P.weighted_quantiles(v, np.ones(1000), [0.0, 0.5, 1.0]) == [0.0, 500.0, 999.0]


def test_config_limits():
    with pytest.raises(ValueError):
        DistConfig(confidence=0.5)
    with pytest.raises(ValueError):
        DistConfig(min_dist=0.8, min_dist_given=True)
    with pytest.raises(ValueError):
        DistConfig(quantiles=(0.5, 0.1))


def test_flags():
    assert filters.parse_flags("0x10") == 16 and filters.parse_flags("PAIRED,REVERSE") == 17


def test_cigar_walk(spark):
    read = spark.createDataFrame([("s", "q", 0, 100, "3S5M2I4M1D3M", "A" * 17, 1)], "sample string, qname string, tid int, pos int, cigar string, seq string, strand int")
    ops = [(r.op, r.len, r.r) for r in tally.cigar_ops(read).collect()]
    assert ops == [("S", 3, 100), ("M", 5, 100), ("I", 2, 105), ("M", 4, 105), ("D", 1, 109), ("M", 3, 110)]


def test_regions_that_touch_stay_apart(spark):
    r = spark.createDataFrame([(0, 1, 5), (0, 4, 9), (0, 9, 12), (0, 20, 22)], "tid int, beg int, stop int")
    assert sorted((x.beg, x.stop) for x in regions.merge_regions(r).collect()) == [(1, 9), (9, 12), (20, 22)]


def test_bad_ranges_fail(spark):
    contigs = spark.createDataFrame([(0, "a", 10)], "tid int, name string, len int")
    for row in (("b", 1, 2), ("a", 0, 2), ("a", 3, 2)):
        with pytest.raises(Exception):
            regions.parse_ranges(spark.createDataFrame([row], "contig string, first int, last int"), contigs).collect()


def test_indel_pairs(spark):
    rows = [("A", 0, 5, True, 2, "TA", 1), ("A", 0, 5, True, 2, "TT", 1), ("A", 0, 5, True, 2, "TG", 127), ("B", 0, 5, True, 1, "G", 1), ("B", 0, 5, True, 2, "TG", 112), ("B", 0, 5, False, 3, None, 4)]
    df = spark.createDataFrame(rows, "sample string, tid int, pos int, is_ins boolean, len int, seq string, ct long")
    out = align.indel_pairs(df, spark.createDataFrame([("A", "B")], "s1 string, s2 string")).collect()
    assert sorted((r.seq or "-", r.ct1, r.ct2) for r in out) == [("-", 0, 4), ("G", 0, 1), ("TA", 1, 0), ("TG", 127, 112), ("TT", 1, 0)]


def test_canonical_pair_ignores_order(spark):
    a, b = [0, 2, 725, 10], [2, 1, 695, 8]
    def key(order):
        k = align.canonical_pair([F.lit(a[i]) for i in order], [F.lit(b[i]) for i in order])
        return spark.range(1).select(k.alias("k")).first().k

    assert key([0, 1, 2, 3]) == key([3, 1, 0, 2]) == key([2, 3, 1, 0])


def test_state_table(spark):
    cases = {(0.0, 1.0): "ambiguous_or_changed", (0.995, 0.999): "unchanged", (0.0, 0.005): "changed", (0.2, 0.8): "ambiguous", (0.2, 0.995): "ambiguous_or_unchanged"}
    df = spark.createDataFrame([k for k in cases], "lo double, hi double")
    for r in df.select("lo", "hi", points.state(F.col("lo"), F.col("hi"), 0.99).alias("s")).collect():
        assert r.s == cases[r.lo, r.hi]


def test_phred_round_trip(spark):
    q = spark.range(50).select(F.col("id").alias("q"), codes.char_quality(codes.quality_char(F.col("id"))).alias("a"), codes.error_quality(codes.error_probability(F.col("id"))).alias("b"))
    assert all(r.q == r.a == r.b for r in q.collect())


def test_step_bounds_enclose_the_integral(spark):
    x = np.linspace(0, 1, 10001)
    df = spark.createDataFrame([(1, float(a), float(np.log2(np.exp(a)))) for a in x], "k int, x double, y double")
    r = points.step_bounds(df, "k", "x", "y").orderBy(F.desc("x")).first()
    true = np.log2(np.e - 1)
    assert r.lower <= true <= r.upper and r.upper - r.lower < 3e-4


def test_simulated_calls_follow_the_prior(spark):
    loci = spark.range(50).select(F.lit(0).alias("tid"), F.col("id").cast("int").alias("pos"))
    n = {r.base: r["count"] for r in simulate.draw_bases(loci, [(0.5, 0.5, 0, 0, 1.0)], 100, 40).groupBy("base").count().collect()}
    assert abs(n["A"] - 2500) < 200 and abs(n["C"] - 2500) < 200
    a, b = simulate.points_at_distance(50, 0.3)
    assert np.allclose(np.linalg.norm(a - b, axis=1), 0.3) and (b >= 0).all()


def block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_alignment_file(spark, tmp_path):
    name, seq, qual = b"r1\0", "ACGTN", [30, 31, 32, 33, 34]
    codes_ = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(codes_[i] << 4 | codes_[i + 1] for i in range(0, 6, 2))
    record = struct.pack("<iiBBHHHiiii", 0, 7, len(name), 60, 0, 2, 16, 5, -1, -1, 0) + name + struct.pack("<II", 3 << 4, 2 << 4 | 4) + packed + bytes(qual) + b"NMC\1RGZg1\0"
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100)
    stream = head + struct.pack("<i", len(record)) + record
    (tmp_path / "x.bam").write_bytes(block(stream[:40]) + block(stream[40:]) + block(b""))
    spark.dataSource.register(formats.AlignmentSource)
    r = spark.read.format("alignments").option("samples", f"s={tmp_path}/x.bam").load().collect()
    assert [(x.sample, x.qname, x.flag, x.tid, x.pos, x.mapq, x.cigar, x.seq, list(x.qual), x.rg) for x in r] == [("s", "r1", 16, 0, 7, 60, "3M2S", "ACGTN", qual, "g1")]


def test_text_and_depth_formats(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\t/x\nb\t/y\n")
    samples = formats.read_samples(spark, str(tmp_path / "s.tsv"))
    (tmp_path / "p.tsv").write_text("a\tb\na\tREF\n")
    assert formats.read_pairs(spark, str(tmp_path / "p.tsv"), samples).count() == 2
    (tmp_path / "q.tsv").write_text("a\tz\n")
    with pytest.raises(ValueError):
        formats.read_pairs(spark, str(tmp_path / "q.tsv"), samples)
    (tmp_path / "d.bin").write_bytes(formats.pack_depth([("chr1", "1", 3), ("chr2", "2", 2)], [1, 2, 3, 4, 5]))
    got = [(r.contig, r.pos, r.depth) for r in formats.read_dense_depth(spark, str(tmp_path / "d.bin")).orderBy("contig", "pos").collect()]
    assert got == [("chr1", 1, 1.0), ("chr1", 2, 2.0), ("chr1", 3, 3.0), ("chr2", 1, 4.0), ("chr2", 2, 5.0)]
    (tmp_path / "f.fastq").write_text("@a\nAC\n+\n!J\n@b\nGT\n+\nII\n")
    assert [(r.seq, r.qual) for r in formats.read_fastq(spark, str(tmp_path / "f.fastq")).orderBy("record").collect()] == [("AC", "!J"), ("GT", "II")]


def test_comparison_queries_draw_the_default_points(spark):
    config = dist.DistConfig()
    assert value_queries.CONFIG == config and config.points == 10_016
    got = {(x.a, x.b): x.state for x in extra_queries.QUERIES["distance_table"](spark, "").collect()}
    keys = sorted(got)
    both = [(np.array([a, 2, 0, 0]) + config.prior, np.array([2, b, 0, 0]) + config.prior) for a, b in keys]
    assert [got[k] for k in keys] == [x[0] for x in P.compare_all(both, config.threshold, config.confidence, config.points)]
