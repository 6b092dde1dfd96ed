"""Alignment files with an index, FASTA, FASTQ and depth files over several partitions, and the composed commands."""

import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.operators import sequences, tally
from locuspark.plans import commands
from locuspark.plans.dist import DistConfig
from locuspark.sources import alignment_index as ix
from locuspark.sources import formats, rows
from locuspark.streaming import incremental
from tests.test_functions import block

LENGTHS = {"chr1": 200_000, "chr2": 50_000}


def bin_of(beg, stop):
    return max(ix.bins_of(beg, stop - 1) if stop - 1 > beg else ix.bins_of(beg, beg + 1)) if (stop - 1) >> 14 == beg >> 14 else next(
        first + (beg >> shift) for first, shift in reversed(ix.LEVELS) if beg >> shift == (stop - 1) >> shift
    )


def record(name, flag, tid, pos, mapq, ops, seq, qual):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    cigar = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in ops)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + cigar + packed + bytes(qual)
    return struct.pack("<i", len(body)) + body


def write_alignments(path, reads):
    """A file of small blocks that records straddle, and its index."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(LENGTHS))
    for name, n in LENGTHS.items():
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    stream, starts = bytearray(head), []
    for r in reads:
        starts.append(len(stream))
        stream += record(*r)
    size, out, at = 700, bytearray(), []
    for lo in range(0, len(stream), size):
        at.append(len(out))
        out += block(bytes(stream[lo : lo + size]))
    at.append(len(out))
    path.write_bytes(bytes(out) + block(b""))
    voffset = lambda p: ix.join_offset(at[p // size], p % size)
    bins, linear = [{} for _ in LENGTHS], [{} for _ in LENGTHS]
    for r, beg, end in zip(reads, starts, [*starts[1:], len(stream)]):
        tid, pos, ops = r[2], r[3], r[5]
        if tid < 0:
            continue
        stop = pos + sum(n for n, op in ops if op in "MDN=X")
        bins[tid].setdefault(bin_of(pos, stop), []).append((voffset(beg), voffset(end)))
        for w in range(pos >> 14, ((stop - 1) >> 14) + 1):
            linear[tid].setdefault(w, voffset(beg))
    raw = b"BAI\1" + struct.pack("<i", len(LENGTHS))
    for b, lin in zip(bins, linear):
        raw += struct.pack("<i", len(b) + 1)
        for name, chunks in b.items():
            chunks = ix.merge_chunks(chunks)
            raw += struct.pack("<Ii", name, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        raw += struct.pack("<Ii", ix.META_BIN, 2) + struct.pack("<4Q", 0, 0, 0, 0)
        n = max(lin, default=-1) + 1
        held, last = [], 0
        for w in range(n):
            last = lin.get(w, last)
            held.append(last)
        raw += struct.pack("<i", n) + struct.pack(f"<{n}Q", *held)
    path.with_name(path.name + ".bai").write_bytes(raw)


@pytest.fixture(scope="module")
def aligned(tmp_path_factory):
    r, reads = random.Random(4), []
    for i in range(700):
        tid = int(i >= 550)
        pos = r.randrange(0, (200_000 if tid == 0 else 50_000) - 3000)
        ops = r.choice([[(40, "M")], [(10, "M"), (2, "I"), (28, "M")], [(20, "M"), (2000, "N"), (20, "M")], [(5, "S"), (30, "M"), (3, "D"), (5, "M")]])
        n = sum(k for k, op in ops if op in "MIS=X")
        reads.append((f"r{i}", r.choice([0, 16]), tid, pos, r.choice([5, 60]), ops, "".join(r.choice("ACGTN") for _ in range(n)), [r.randrange(2, 41) for _ in range(n)]))
    reads.sort(key=lambda x: (x[2], x[3]))
    reads.append(("loose", 4, -1, -1, 0, [], "ACGT", [30] * 4))
    path = tmp_path_factory.mktemp("bam") / "a.bam"
    write_alignments(path, reads)
    return path, reads


def load(spark, path, **options):
    spark.dataSource.register(formats.AlignmentSource)
    reader = spark.read.format("alignments").option("samples", f"s={path}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def names(df):
    return sorted(x.qname for x in df.select("qname").collect())


def test_split_scan_reads_every_record_once(spark, aligned):
    path, reads = aligned
    whole = load(spark, path, split_bytes=2000)
    assert whole.rdd.getNumPartitions() > 3
    assert names(whole) == sorted(r[0] for r in reads)
    assert names(load(spark, f"file://{path}", indexes="s=/nowhere.bai")) == sorted(r[0] for r in reads)


@pytest.mark.parametrize("text", ["0:0-200000;1:0-50000", "0:1000-1001", "0:30000-52000;0:40000-90000", "1:0-10;0:199999-200000", "1:16384-32768", "5:0-10"])
def test_regions_against_all_records(spark, aligned, text):
    path, reads = aligned
    wanted = formats.parse_region_option(text)
    want = []
    for r in reads:
        stop = r[3] + sum(n for n, op in r[5] if op in "MDN=X")
        if any(r[2] == t and r[3] < e and stop > b for t, b, e in wanted):
            want.append(r[0])
    assert names(load(spark, path, regions=text, split_bytes=3000)) == sorted(want)
    # Only a few bytes are planned for a narrow region.
    if text == "0:1000-1001":
        with open(f"{path}.bai", "rb") as f:
            ranges = ix.plan(ix.parse_index(f.read()), wanted, 0, 1 << 30)
        assert sum(map(ix.chunk_bytes, ranges)) < 0.3 * path.stat().st_size


def test_offsets_bins_and_chunks():
    assert ix.split_offset(ix.join_offset(123456789, 4321)) == (123456789, 4321)
    r = random.Random(1)
    for _ in range(200):
        beg = r.randrange(0, 1 << 28)
        stop = beg + r.randrange(1, 1 << r.randrange(1, 24))
        assert bin_of(beg, stop) in ix.bins_of(beg, stop) and ix.bins_of(beg, stop)[0] == 0
    assert ix.merge_chunks([(5, 9), (1, 3), (3, 4), (8, 12), (7, 7)]) == [(1, 4), (5, 12)]
    with pytest.raises(ValueError):
        ix.parse_index(b"nothing")
    with pytest.raises(ValueError):
        formats.parse_region_option("0:5-5")


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    r = random.Random(9)
    text = {n: "".join(r.choice("ACGTacgtN") for _ in range(size)) for n, size in LENGTHS.items()}
    path, out, index = tmp_path_factory.mktemp("fa") / "ref.fa", "", ""
    for n, s in text.items():
        out += f">{n} words\n"
        index += f"{n}\t{len(s)}\t{len(out)}\t70\t71\n"
        out += "".join(s[i : i + 70] + "\n" for i in range(0, len(s), 70))
    path.write_text(out)
    path.with_name("ref.fa.fai").write_text(index)
    return path, {n: s.upper() for n, s in text.items()}


def test_fasta_tiles_and_regions(spark, fasta):
    path, text = fasta
    tiles = formats.read_fasta_tiles(spark, str(path), width=1000)
    whole = {}
    for x in tiles.orderBy("tid", "tile").collect():
        whole[x.tid] = whole.get(x.tid, "") + x.seq
    assert list(whole.values()) == list(text.values())
    spans = spark.createDataFrame([(0, 0, 10), (0, 995, 3005), (1, 49_990, 50_010)], "tid int, beg int, stop int")
    got = {(x.tid, x.beg): x.seq for x in sequences.fetch(spans, tiles, 1000).collect()}
    assert got == {(0, 0): text["chr1"][:10], (0, 995): text["chr1"][995:3005], (1, 49_990): text["chr2"][49_990:]}
    index = formats.read_fai(spark, f"{path}.fai").orderBy("tid").collect()
    assert [(x.tid, x.name, x.len) for x in index] == [(0, "chr1", 200_000), (1, "chr2", 50_000)]


def test_fastq_streams(spark, tmp_path):
    lines = "".join(f"@r{i}\n{'ACGT' * 3}\n+\n{'I' * 12}\n" for i in range(53))
    (tmp_path / "a.fastq").write_text(lines)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(lines)
    got = formats.read_fastq(spark, str(tmp_path), 10).groupBy("file").agg(F.count("*").alias("n"), F.max("record").alias("last"), F.count_distinct("id").alias("ids")).collect()
    assert sorted((x.n, x.last, x.ids) for x in got) == [(53, 52, 53)] * 2
    (tmp_path / "c.fastq").write_text("@a\nAC\n+\n")
    with pytest.raises(Exception, match="truncated"):
        formats.read_fastq(spark, str(tmp_path / "c.fastq")).collect()


def test_depth_files_by_chunks(spark, tmp_path):
    contigs = [("chr1", "1", 25), ("chr2", "2", 8)]
    track = spark.createDataFrame([("chr1", 1, 2.0), ("chr1", 11, 5.0), ("chr1", 25, 1.5), ("chr2", 8, 9.0)], "contig string, pos int, depth double")
    path = str(tmp_path / "d.bin")
    formats.write_dense_depth(track, contigs, path, 10)
    got = formats.read_dense_depth(spark, path, 7).collect()
    assert len(got) == 33 and {(x.contig, x.pos): x.depth for x in got if x.depth} == {("chr1", 1): 2.0, ("chr1", 11): 5.0, ("chr1", 25): 1.5, ("chr2", 8): 9.0}
    for bad in (("chr9", 1), ("chr2", 9), ("chr1", 0)):
        with pytest.raises(Exception, match="unknown contig or position"):
            formats.write_dense_depth(spark.createDataFrame([(*bad, 1.0)], "contig string, pos int, depth double"), contigs, path, 10)


def test_small_text_files(spark, tmp_path):
    files = {
        "dict": "chr2\t50\nChr10\t70\nx\t5\n", "rg": "g1\n\n g2 \ng1\n", "depth": "a\t/p\tY\t12.5\tnone\nb\t/q\tN\t3\tchrX  chrY\n",
        "numbers": "1 2.5\n\n-3e2\t4\n", "sparse": "chr1\t5\tA\t2.5\n", "ranges": "chr1\t1\t5\n",
    }
    for k, v in files.items():
        (tmp_path / k).write_text(v)
    at = lambda k: str(tmp_path / k)
    assert [tuple(x) for x in formats.read_contigs(spark, at("dict")).orderBy("tid").collect()] == [(0, "chr2", "2", 50), (1, "Chr10", "10", 70), (2, "x", "x", 5)]
    assert sorted(x.rg for x in formats.read_groups(spark, at("rg")).collect()) == ["g1", "g2"]
    assert [(x.name, x.is_norm, x.avg_depth, list(x.haploid)) for x in formats.read_depth_index(spark, at("depth")).orderBy("name").collect()] == [("a", True, 12.5, []), ("b", False, 3.0, ["chrX", "chrY"])]
    assert sorted(x.value for x in formats.read_numbers(spark, at("numbers")).collect()) == [-300.0, 1.0, 2.5, 4.0]
    assert [tuple(x) for x in formats.read_sparse_pileup(spark, at("sparse")).collect()] == [("chr1", 5, 2.5)]
    assert [tuple(x) for x in formats.read_ranges(spark, at("ranges")).collect()] == [("chr1", 1, 5)]
    out = str(tmp_path / "out")
    formats.write_tsv(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), out, "n")
    assert [tuple(x) for x in formats.read_tsv(spark, out, "n int, s string").collect()] == [(1, "a"), (2, "b")]


READS = "sample string, qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, qual array<int>, mtid int, mpos int, rg string"


def test_mates(spark):
    q = [30] * 10
    made = [
        ("s", "over", 3, 0, 10, 60, "10M", "A" * 10, q, 0, 15, None), ("s", "over", 3, 0, 15, 60, "10M", "A" * 10, q, 0, 10, None),
        ("s", "apart", 3, 0, 10, 60, "4M", "A" * 4, q[:4], 0, 15, None), ("s", "apart", 3, 0, 15, 60, "4M", "A" * 4, q[:4], 0, 10, None),
        ("s", "same", 67, 0, 5, 60, "3M", "AAA", q[:3], 0, 5, None), ("s", "same", 131, 0, 5, 60, "3M", "AAA", q[:3], 0, 5, None),
        ("s", "lost", 3, 0, 10, 60, "10M", "A" * 10, q, 0, 12, None), ("s", "alone", 0, 0, 10, 60, "10M", "A" * 10, q, -1, -1, None),
        ("s", "improper", 1, 0, 10, 60, "10M", "A" * 10, q, 0, 12, None), ("s", "improper", 1, 0, 12, 60, "10M", "A" * 10, q, 0, 10, None),
        ("t", "over", 3, 0, 10, 60, "5M3D2M", "A" * 7, q[:7], 0, 20, None), ("t", "over", 3, 0, 20, 60, "5M", "A" * 5, q[:5], 0, 10, None),
    ]
    pairs, single = tally.mate_pairs(spark.createDataFrame(made, READS))
    assert sorted((x.a.sample, x.a.qname, x.a.pos, x.b.pos, x.a.flag) for x in pairs.collect()) == [("s", "over", 10, 15, 3), ("s", "same", 5, 5, 67), ("t", "over", 10, 20, 3)]
    assert sorted((x.qname, x.pos) for x in single.collect()) == [("alone", 10), ("apart", 10), ("apart", 15), ("improper", 10), ("improper", 12), ("lost", 10)]


def test_walks_agree(spark):
    made = [(f"s{i}", i, c) for i, c in enumerate(["5M", "2S3M1I4M2D1M", "5M", "3=1X2N4M", "4H2M", ""])]
    df = spark.createDataFrame(made, "sample string, pos int, cigar string")
    shared, own = tally.cigar_ops(df).collect(), tally.walk_cigars(df).collect()
    assert sorted(map(tuple, shared)) == sorted(map(tuple, own)) and len(own) > 10


def test_ranks_of_many_points(spark):
    r = np.random.default_rng(2)
    x = r.choice([0.1, 0.2, 0.5], 3000) + r.random(3000) * (r.random(3000) > 0.3)
    df = spark.createDataFrame([(i, float(v), float(-v)) for i, v in enumerate(x)], "id int, a double, b double")
    got = {(y.dim, y.id): y["rank"] for y in rows.numerical_cdfs(df, ["a", "b"], "id", 16).collect()}
    for dim, v in ((0, x), (1, -x)):
        for rank, i in enumerate(np.lexsort((np.arange(3000), v))):
            assert got[dim, i] == rank


def test_commands_from_files_to_files(spark, aligned, fasta, tmp_path):
    path, reads = aligned
    contigs = formats.read_fai(spark, f"{fasta[0]}.fai")
    # Kept as parquet, as the commands read them many times.
    load(spark, path, split_bytes=5000).where("tid >= 0").write.parquet(str(tmp_path / "reads"))
    formats.read_fasta_tiles(spark, str(fasta[0])).write.parquet(str(tmp_path / "tiles"))
    df, tiles = spark.read.parquet(str(tmp_path / "reads")), spark.read.parquet(str(tmp_path / "tiles"))
    both = df.union(df.withColumn("sample", F.lit("t")).withColumn("seq", F.translate("seq", "ACGT", "CATG")))
    ranges = spark.createDataFrame([("chr1", 1, 60_000), ("chr2", 100, 9000)], "contig string, first int, last int")
    config = commands.ReadConfig(ranges=ranges)
    pile = commands.pileup(both, contigs, tiles, config).collect()
    kept = [r for r in reads if r[4] >= 10]
    depth = {}
    for _, flag, tid, pos, _, ops, seq, qual in kept:
        q, at = 0, pos
        for n, op in ops:
            if op == "M":
                for k in range(n):
                    if (tid == 0 and at + k < 60_000) or (tid == 1 and 99 <= at + k < 9000):
                        depth.setdefault((tid, at + k), []).append((seq[q + k], qual[q + k]))
            q += n if op in "MIS" else 0
            at += n if op in "MDN" else 0
    mine = {(x.contig, x.pos): x for x in pile if x["sample"] == "s"}
    assert set(mine) == {(f"chr{t + 1}", p + 1) for t, p in depth}
    for (t, p), calls in depth.items():
        x = mine[f"chr{t + 1}", p + 1]
        assert x.n_hi == sum(q >= 5 for _, q in calls) and len(x.quals) == len(calls) and x.ref_base == fasta[1][f"chr{t + 1}"][p]
    assert sum(x.n_loci for x in commands.quality_statistics(both, contigs, tiles, config).collect()) == 2 * len(depth)
    pairs = spark.createDataFrame([("s", "t"), ("s", "REF")], "s1 string, s2 string")
    narrow = commands.ReadConfig(ranges=spark.createDataFrame([("chr1", 1, 1500)], "contig string, first int, last int"))
    made = commands.compare(both, contigs, tiles, pairs, DistConfig(max_points=500), narrow, with_pileup=True)
    out = {k: str(tmp_path / k) for k in ("distances", "summary")}
    assert sorted(commands.write(made, out | {"indels": "/dev/null", "compositions": ""})) == ["distances", "summary"]
    summary = formats.read_tsv(spark, out["summary"], "s1 string, s2 string, total long, a long, b long, c long, u long, m long, ch long, ac long, au long").collect()
    assert {(x.s1, x.s2) for x in summary} == {("s", "t"), ("s", "REF")} and all(x.total == x.u + x.m + x.ch + x.ac + x.au for x in summary)
    assert {"s1_calls", "s2_quals", "s2_n_hi"} <= set(made["distances"].columns) and "s1_n_indel" in made["indels"].columns
    with pytest.raises(ValueError):
        commands.write(made, {"summary": "x"})


def test_depth_commands(spark):
    track = spark.createDataFrame([(s, "c", p, float((p * (s + 3)) % 7)) for s in (0, 1) for p in range(1, 101) if p % 5], "sample int, contig string, pos int, depth double")
    contigs = spark.createDataFrame([("c", 100), ("d", 30)], "contig string, len int")
    samples = spark.createDataFrame([(0, True, 3.0, []), (1, False, 2.0, ["c"])], "sample int, is_norm boolean, avg_depth double, haploid array<string>")
    config = commands.DepthConfig(width=10, every=5, per_unit=2, bins=6, contig="c")
    made = commands.depth_statistics(track, contigs, samples, config)
    whole = {(s, p): (p * (s + 3)) % 7 if p % 5 else 0 for s in (0, 1) for p in range(1, 101)}
    got = {(x["sample"], x.locus): x for x in made["windows"].collect()}
    assert set(got) == {(s, k) for s in (0, 1) for k in range(5, 96, 5)}
    for (s, k), x in got.items():
        mean = lambda t: np.mean([whole[t, p] / (3 - t) for p in range(k - 4, k + 6)])  # noqa: B023, E731
        assert x["mean"] == pytest.approx(mean(s)) and x["local"] == pytest.approx(mean(0))
    assert sum(x["count"] for x in made["histogram"].collect()) == 2 * 91
    assert sum(x["count"] for x in commands.window_average(track, commands.DepthConfig(width=10, every=5, per_unit=1, bins=9))["histogram"].collect()) > 150
    values = spark.createDataFrame([(0.1,), (0.6,), (2.9,), (3.0,), (7.0,)], "value double")
    assert [(x.bin_center, x["count"]) for x in commands.histogram_1d(values, "t", 2, 3).orderBy("bin_center").collect()] == [(0.25, 1), (0.75, 1), (1.25, 0), (1.75, 0), (2.25, 0), (2.75, 1)]
    with pytest.raises(ValueError):
        commands.DepthConfig(width=0)


def test_complete_up_to(spark):
    loci = spark.createDataFrame([("a", 0, 5), ("a", 0, 9), ("b", 1, 1)], "sample string, tid int, pos int")
    seen = spark.createDataFrame([("a", 0, 9), ("a", 0, 2), ("b", 0, 7), ("b", 0, 8)], "sample string, tid int, pos int")
    assert sorted((x.tid, x.pos) for x in incremental.complete_up_to(loci, seen).collect()) == [(0, 5)]


def test_counting_helpers():
    from math import comb, log

    from locuspark.functions import counting as C

    assert C.log_choose(10, 3) == pytest.approx(log(comb(10, 3))) and C.log_multinomial([2, 3, 1]) == pytest.approx(log(60))
    assert C.log_flip_ratio(10, 7, 0.6) == pytest.approx(log(comb(10, 7) * 0.6**7 * 0.4**3) - log(comb(10, 3) * 0.6**3 * 0.4**7))
    for sign in (1, -1):
        assert C.search(lambda x: sign * x * x, 0, 10, sign * 27.456, 1e-9) == pytest.approx(27.456**0.5)
    assert C.chunk_starts(10, 3) == [0, 3, 6, 10]


def test_flavours_that_are_not_clear_fail(spark):
    records = spark.createDataFrame([("s", "!5I"), ("w", "hB"), ("x", "DEF"), ("none", "z!")], "file string, qual string")
    fits = sequences.quality_flavours(records, "file")
    assert [tuple(x) for x in sequences.flavour(fits.where("file in ('s', 'w')"), "file").orderBy("file").collect()] == [("s", "Sanger"), ("w", "Solexa")]
    for name in ("x", "none"):
        with pytest.raises(Exception, match="not clear"):
            sequences.flavour(fits.where(F.col("file") == name), "file").collect()
