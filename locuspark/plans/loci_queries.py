"""Queries on reads and loci, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from locuspark.functions import codes
from locuspark.operators import align, filters, regions, sequences, tally
from locuspark.sources import adapters as A

R, C = A.READS_SQL, A.REGIONS_CLIPPED_SQL
_OK = "mapq >= 10"
CALLS_SQL = f"{R}, calls AS (SELECT * FROM reads WHERE {_OK})"
BASES_SQL = (
    f"{CALLS_SQL}, bases AS (SELECT sample, tid, pos, "
    + ", ".join(f"count(*) FILTER (WHERE base = '{b}' AND qual >= 5) AS {b.lower()}" for b in "ACGT")
    + ", count(*) FILTER (WHERE base <> 'N' AND qual < 5) AS n_lo, count(*) FILTER (WHERE base <> 'N' AND qual >= 5) AS n_hi, count(*) FILTER (WHERE base = 'N') AS n_fuzzy"
    " FROM calls GROUP BY sample, tid, pos)"
)
BQS_SQL = f"{CALLS_SQL}, bqs AS (SELECT sample, tid, pos, ref_base, base, qual, strand, count(*) AS ct FROM calls GROUP BY sample, tid, pos, ref_base, base, qual, strand)"
CIGAR_SQL = f"""{CALLS_SQL}, kinds AS (SELECT DISTINCT cigar FROM calls),
walk AS (
  SELECT cigar, cigar AS rest, CAST('' AS VARCHAR) AS op, 0 AS len, 0 AS q, 0 AS r, 0 AS nq, 0 AS nr FROM kinds
  UNION ALL
  SELECT cigar, substr(rest, length(regexp_extract(rest, '^([0-9]+)', 1)) + 2), regexp_extract(rest, '^[0-9]+([A-Z=])', 1), CAST(regexp_extract(rest, '^([0-9]+)', 1) AS INTEGER), nq, nr,
    nq + CASE WHEN regexp_extract(rest, '^[0-9]+([A-Z=])', 1) IN ('M','=','X','I','S') THEN CAST(regexp_extract(rest, '^([0-9]+)', 1) AS INTEGER) ELSE 0 END,
    nr + CASE WHEN regexp_extract(rest, '^[0-9]+([A-Z=])', 1) IN ('M','=','X','D','N') THEN CAST(regexp_extract(rest, '^([0-9]+)', 1) AS INTEGER) ELSE 0 END
  FROM walk WHERE rest <> ''
), ops AS (SELECT c.*, w.op, w.len AS oplen, w.q, c.pos + w.r AS r FROM calls c JOIN walk w ON c.cigar = w.cigar AND w.op <> '')"""
INDEL_SQL = f"""{CIGAR_SQL}, indels AS (
  SELECT sample, tid, r AS pos, op = 'I' AS is_ins, oplen AS len, CASE WHEN op = 'I' THEN substr(seq, q + 1, oplen) END AS seq, count(*) AS ct
  FROM ops WHERE op IN ('I', 'D') GROUP BY ALL
)"""
_GONE = "array_to_string(list_transform(range(pos, pos + len), lambda p: substr('ACGT', CAST((tid * 31 + p * 7) % 4 + 1 AS BIGINT), 1)), '')"
SPELLED_SQL = f"{INDEL_SQL}, spelled AS (SELECT sample, tid, pos, is_ins, len, CASE WHEN is_ins THEN seq ELSE {_GONE} END AS seq, ct FROM indels)"
LOCI_SQL = f"""{C}, ends AS (SELECT *, max(stop) OVER (PARTITION BY tid ORDER BY beg, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM regions),
isles AS (SELECT *, sum(CASE WHEN beg < far THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY beg, stop) AS island FROM ends),
merged AS (SELECT tid, min(beg) AS beg, max(stop) AS stop FROM isles GROUP BY tid, island),
loci AS (SELECT tid, CAST(unnest(range(beg, stop)) AS INTEGER) AS pos FROM merged)"""
LOCI_REF_SQL = LOCI_SQL + f", known AS (SELECT tid, pos, {A.REF_BASE.format(tid='tid', pos='pos')} AS ref_base FROM loci)"


def calls(spark, sf):
    return A.reads(spark, sf).where(filters.keep_reads(10))


def bases(spark, sf):
    return tally.count_bases(calls(spark, sf))


def bqs(spark, sf):
    return tally.count_bqs(calls(spark, sf))


def bqs_ref(spark, sf):
    return calls(spark, sf).groupBy("sample", "tid", "pos", "ref_base", "base", "qual", "strand").agg(F.count("*").alias("ct"))


def indels(spark, sf):
    return tally.count_indels(tally.indel_events(calls(spark, sf)))


def clipped(spark):
    return regions.parse_ranges(A.regions(spark), A.contigs(spark))


def merged(spark):
    return regions.merge_regions(clipped(spark))


def loci(spark):
    return regions.loci(merged(spark))


def with_ref(df):
    return df.withColumn("ref_base", F.expr(A.REF_BASE.format(tid="tid", pos="pos")))


def _read_filter(spark, sf):
    return A.reads(spark, sf).where(filters.keep_reads(10, 0, 16)).select("sample", "qname", "tid", "pos", "mapq", "flag")


def _readgroup_filter(spark, sf):
    groups = spark.createDataFrame([("rg0",), ("rg3",)], "rg string")
    return filters.in_read_groups(A.reads(spark, sf), groups).groupBy("sample", "rg").agg(F.count("*").alias("n"))


def _region_semi(spark, sf):
    rows = A.reads(spark, sf).withColumn("stop", F.col("pos") + 18)
    return regions.overlapping(rows, merged(spark), "pos", "stop", 18, 64).groupBy("sample", "tid").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def _windows(spark, sf):
    return A.reads(spark, sf).select("tid", F.col("pos").alias("beg"), (F.col("pos") + 18).alias("stop")).distinct()


def _region_intersect(spark, sf):
    return regions.intersect_regions(_windows(spark, sf), merged(spark), 64)


def _cigar_explode(spark, sf):
    return tally.aligned_bases(calls(spark, sf)).groupBy("sample", "tid", "pos", "base", "strand").agg(F.count("*").alias("ct"))


def _cigar_ops(spark, sf):
    return tally.cigar_ops(calls(spark, sf)).groupBy("op", "tid").agg(F.count("*").alias("n"), F.sum("len").alias("bases"), F.sum("q").alias("sum_q"), F.sum("r").alias("sum_r"))


def reference(spark):
    """Tiles of the reference that the test tables imply."""
    whole = spark.range(A.CONTIGS).select(F.col("id").cast("int").alias("tid"))
    letters = F.transform(F.sequence(F.lit(0), F.lit(A.CONTIG_LENGTH + 49)), lambda p: F.substr(F.lit("ACGT"), (F.col("tid") * 31 + p * 7) % 4 + 1, F.lit(1)))
    return sequences.tiles(whole.select("tid", F.array_join(letters, "").alias("ref")))


def spelled_indels(spark, sf):
    return tally.indel_sequence(indels(spark, sf), reference(spark))


def _reified(spark, sf):
    return spelled_indels(spark, sf).groupBy("sample", "is_ins", "len", "seq").agg(F.sum("ct").alias("ct"))


def mates(spark, sf):
    """Reads of an order on one contig, two by two in order, as first and second of a fragment."""
    rows = A.reads(spark, sf)
    keyed = rows.select(F.concat_ws(":", "fragment", "tid").alias("whole"), F.struct("qname", "sample", "tid", (F.col("pos") % 16).alias("pos"), "cigar", "seq", "qual", "strand").alias("a"))
    order = Window.partitionBy("whole").orderBy("a")
    placed = keyed.withColumns({"place": F.row_number().over(order) - 1, "b": F.lead("a").over(order)}).where("place % 2 = 0 and b is not null")
    return placed.select(F.concat_ws(":", "whole", F.floor(F.col("place") / 2).cast("string")).alias("fragment"), "a", "b")


MATES_SQL = f"""{R}, m AS (
  SELECT CAST(fragment AS VARCHAR) || ':' || CAST(tid AS VARCHAR) AS whole, qname, sample, pos % 16 AS pos, cigar, seq, qual, strand FROM reads
), placed AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY qname, sample, pos, cigar, seq, qual, strand) - 1 AS place FROM m),
n AS (SELECT whole || ':' || CAST(place // 2 AS VARCHAR) AS fragment, place % 2 + 1 AS up, count(*) OVER (PARTITION BY whole, place // 2) AS k, qname, sample, pos, cigar, seq, qual, strand FROM placed),
a AS (SELECT * FROM n WHERE up = 1 AND k = 2), b AS (SELECT * FROM n WHERE up = 2 AND k = 2),
calls AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""
OFFSET_SQL = MATES_SQL + CIGAR_SQL.removeprefix(CALLS_SQL).replace("SELECT c.*, w.op", "SELECT c.fragment, c.up = 1 AS first, w.op") + """,
v AS (
  SELECT x.fragment, (y.r - y.q) - (x.r - x.q) AS off, sum(least(x.oplen, y.oplen)) AS support
  FROM ops x JOIN ops y ON x.fragment = y.fragment AND x.first AND NOT y.first AND x.op = 'M' AND y.op = 'M' AND x.r < y.r + y.oplen AND y.r < x.r + x.oplen GROUP BY 1, 2
), best AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY support DESC, off) AS k FROM v)"""


def _overlap_quality(spark, sf):
    m = mates(spark, sf).where("a.cigar is not null")
    q = lambda side: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (F.col(f"{side}.qual") + i * 7) % 45)
    rows = m.join(tally.overlap_offset(m), "fragment").select("fragment", F.col("a.seq").alias("seq0"), F.col("b.seq").alias("seq1"), q("a").alias("q0"), q("b").alias("q1"), "off")
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    return tally.consolidate_overlap(rows).select("fragment", total("q0").alias("sum0"), total("q1").alias("sum1"))


def _sample_align(spark, sf):
    return align.at_loci(loci(spark), A.SAMPLES, bases(spark, sf))


def _ref_pseudo(spark, sf):
    ref = with_ref(loci(spark))
    return align.reference_counts(ref).select("tid", "pos", *align.COUNTS).join(align.reference_bqs(ref).select("tid", "pos", "base", "qual", "ct"), ["tid", "pos"])


def _pileup(spark, sf):
    return align.pileup_strings(bqs_ref(spark, sf))


def _pileup_full(spark, sf):
    return align.pileup_strings(bqs_ref(spark, sf), spelled_indels(spark, sf))


def _depths(spark, sf):
    return _pileup(spark, sf).select("sample", "tid", (F.col("pos") + 1).alias("pos"), "ref_base", "n_hi", "n_lo")


def _majority(spark, sf):
    return bases(spark, sf).select("sample", "tid", "pos", align.majority_base(F.col("a"), F.col("c"), F.col("g"), F.col("t")).alias("major"))


def _pstats(spark, sf):
    return align.quality_histogram(calls(spark, sf))


def paired(spark, sf):
    counts = bases(spark, sf)
    ref = align.reference_counts(with_ref(align.present_loci(counts)))
    return align.sample_pairs(counts.unionByName(ref), A.pairs(spark), ["a", "c", "g", "t"])


PAIRED_SQL = BASES_SQL + f""", {A.PAIRS_SQL},
present AS (SELECT DISTINCT tid, pos FROM bases),
refs AS (SELECT 'REF' AS sample, tid, pos, {A.REF_BASE.format(tid='tid', pos='pos')} AS rb FROM present),
every_ AS (SELECT sample, tid, pos, a, c, g, t FROM bases UNION ALL
  SELECT sample, tid, pos, CASE WHEN rb = 'A' THEN 1000000 ELSE 0 END, CASE WHEN rb = 'C' THEN 1000000 ELSE 0 END, CASE WHEN rb = 'G' THEN 1000000 ELSE 0 END, CASE WHEN rb = 'T' THEN 1000000 ELSE 0 END FROM refs),
paired AS (
  SELECT p.s1, p.s2, x.tid, x.pos, x.a AS a_1, x.c AS c_1, x.g AS g_1, x.t AS t_1, y.a AS a_2, y.c AS c_2, y.g AS g_2, y.t AS t_2
  FROM pairs p JOIN every_ x ON x.sample = p.s1 JOIN every_ y ON y.sample = p.s2 AND y.tid = x.tid AND y.pos = x.pos
)"""
_LIST = "list_sort([" + ", ".join(f"[{b}_1 + {b}_2, {b}_1, {b}_2]" for b in "acgt") + "], 'DESC')"
KEYED_SQL = PAIRED_SQL + f""", keyed AS (SELECT *, {_LIST} AS k FROM paired), named AS (
  SELECT s1, s2, tid, pos, {" || ' ' || ".join(f"CAST(k[{i}][2] AS VARCHAR) || ',' || CAST(k[{i}][3] AS VARCHAR)" for i in (1, 2, 3, 4))} AS key FROM keyed
)"""


def keyed(spark, sf):
    one, two = ([F.col(f"{b}_{i}") for b in "acgt"] for i in (1, 2))
    k = align.canonical_pair(one, two)
    text = F.array_join(F.transform(k, lambda x: F.concat_ws(",", x["c1"].cast("string"), x["c2"].cast("string"))), " ")
    return paired(spark, sf).select("s1", "s2", "tid", "pos", text.alias("key"))


def _survey(spark, sf):
    return keyed(spark, sf).groupBy("key").agg(F.count("*").alias("ct"))


def _single_key(spark, sf):
    k = align.canonical_single([F.col(b) for b in "acgt"])
    return bases(spark, sf).select(F.array_join(F.transform(k, lambda x: x.cast("string")), ",").alias("key")).groupBy("key").agg(F.count("*").alias("ct"))


def _indel_pairs(spark, sf):
    return align.indel_pairs(indels(spark, sf), A.pairs(spark))


def spelled_pairs(spark, sf):
    return align.indel_pairs(spelled_indels(spark, sf), A.pairs(spark))


def _pack(spark, sf):
    b = bqs(spark, sf)
    return b.select("sample", "tid", "pos", "base", "qual", "strand", codes.pack_key(F.col("pos"), F.col("tid"), codes.nt16(F.col("base")), F.col("qual"), F.col("strand")).alias("packed"), "ct")


_CHAR = "CASE WHEN base = ref_base THEN CASE WHEN strand = 1 THEN '.' ELSE ',' END WHEN strand = 1 THEN base ELSE lower(base) END"
_STRINGS = f"string_agg(repeat({_CHAR}, CAST(ct AS INT)), '' ORDER BY base, qual, strand) AS calls, string_agg(repeat(chr(qual + 33), CAST(ct AS INT)), '' ORDER BY base, qual, strand) AS quals"
_HILO = "CAST(coalesce(sum(ct) FILTER (WHERE qual < 5), 0) AS BIGINT) AS n_lo, CAST(coalesce(sum(ct) FILTER (WHERE qual >= 5), 0) AS BIGINT) AS n_hi"
PILE_SQL = f"{BQS_SQL}, pile AS (SELECT sample, tid, pos, ref_base, {_HILO}, {_STRINGS} FROM bqs GROUP BY sample, tid, pos, ref_base)"
FULL_SQL = f"{SPELLED_SQL}, " + PILE_SQL.removeprefix(f"{CALLS_SQL}, ") + """, e AS (
  SELECT sample, tid, pos, CAST(sum(ct) AS BIGINT) AS n_indel,
    string_agg(repeat(CASE WHEN is_ins THEN '+' ELSE '-' END || CAST(length(seq) AS VARCHAR) || seq, CAST(ct AS INT)), '' ORDER BY is_ins, len, seq) AS events FROM spelled GROUP BY sample, tid, pos
), full_pile AS (SELECT p.sample, p.tid, p.pos, ref_base, n_lo, n_hi, coalesce(n_indel, 0) AS n_indel, calls || coalesce(events, '') AS calls, quals
  FROM pile p LEFT JOIN e ON p.sample = e.sample AND p.tid = e.tid AND p.pos = e.pos)"""
_CELLS = ", ".join(
    f"CAST(coalesce(sum(ct) FILTER (WHERE least(qual, 44) // 5 = {i} AND base {'=' if kind == 'major' else '<>'} major), 0) AS BIGINT) AS {kind}_{i}" for kind in ("major", "minor") for i in range(9)
)
_NAMES = ", ".join(f"{kind}_{i}" for kind in ("major", "minor") for i in range(9))
_MAJOR = "CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END"

QUERIES = {
    "read_filter": _read_filter,
    "readgroup_filter": _readgroup_filter,
    "region_parse": lambda s, d: clipped(s),
    "region_merge": lambda s, d: merged(s),
    "region_intersect": _region_intersect,
    "region_semi": _region_semi,
    "span_of_size": lambda s, d: regions.span_of_size(merged(s), 160),
    "region_loci_count": lambda s, d: regions.count_loci(merged(s)),
    "cigar_ops": _cigar_ops,
    "cigar_explode": _cigar_explode,
    "cigar_indels": indels,
    "indel_reify": _reified,
    "tally_bqs": bqs,
    "base_counts": bases,
    "overlap_offset": lambda s, d: tally.overlap_offset(mates(s, d)),
    "overlap_quality": _overlap_quality,
    "dense_loci": lambda s, d: with_ref(loci(s)),
    "skip_empty_loci": lambda s, d: align.present_loci(bases(s, d)),
    "sample_align": _sample_align,
    "ref_pseudo_sample": _ref_pseudo,
    "pileup_strings": _pileup,
    "pileup_with_indels": _pileup_full,
    "pileup_depths": _depths,
    "majority_base": _majority,
    "pstats_histogram": _pstats,
    "pair_enumeration": paired,
    "canonical_key": keyed,
    "alpha_pair_survey": _survey,
    "alpha_survey": _single_key,
    "survey_topn": lambda s, d: align.top_keys(_survey(s, d), 50, "key"),
    "indel_pairs": _indel_pairs,
    "pack_key": _pack,
}
ORACLES = {
    "read_filter": f"WITH {R} SELECT sample, qname, tid, pos, mapq, flag FROM reads WHERE mapq >= 10 AND flag & 16 = 0",
    "readgroup_filter": f"WITH {R} SELECT sample, rg, count(*) AS n FROM reads WHERE rg IS NULL OR rg IN ('rg0', 'rg3') GROUP BY sample, rg",
    "region_parse": f"WITH {C} SELECT * FROM regions",
    "region_merge": f"WITH {LOCI_SQL} SELECT * FROM merged",
    "region_intersect": f"WITH {LOCI_SQL}, {R}, w AS (SELECT DISTINCT tid, pos AS beg, pos + 18 AS stop FROM reads) SELECT w.tid, greatest(w.beg, m.beg) AS beg, least(w.stop, m.stop) AS stop FROM w JOIN merged m ON w.tid = m.tid AND w.beg < m.stop AND m.beg < w.stop",
    "region_semi": f"WITH {LOCI_SQL}, {R} SELECT sample, tid, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM reads r WHERE EXISTS (SELECT 1 FROM merged m WHERE m.tid = r.tid AND r.pos < m.stop AND r.pos + 18 > m.beg) GROUP BY sample, tid",
    "span_of_size": f"WITH {LOCI_SQL}, b AS (SELECT *, coalesce(sum(stop - beg) OVER (ORDER BY tid, beg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged) SELECT tid, beg, CAST(least(stop, beg + (160 - before)) AS INTEGER) AS stop FROM b WHERE before < 160",
    "region_loci_count": f"WITH {LOCI_SQL} SELECT CAST(sum(stop - beg) AS BIGINT) AS n_loci FROM merged",
    "cigar_ops": f"WITH RECURSIVE {CIGAR_SQL} SELECT op, tid, count(*) AS n, CAST(sum(oplen) AS BIGINT) AS bases, CAST(sum(q) AS BIGINT) AS sum_q, CAST(sum(r) AS BIGINT) AS sum_r FROM ops GROUP BY op, tid",
    "cigar_explode": f"WITH RECURSIVE {CIGAR_SQL}, b AS (SELECT *, CAST(unnest(range(0, oplen)) AS INTEGER) AS i FROM ops WHERE op IN ('M', '=', 'X')) SELECT sample, tid, r + i AS pos, substr(seq, q + i + 1, 1) AS base, strand, count(*) AS ct FROM b GROUP BY ALL",
    "cigar_indels": f"WITH RECURSIVE {INDEL_SQL} SELECT * FROM indels",
    "indel_reify": f"WITH RECURSIVE {SPELLED_SQL} SELECT sample, is_ins, len, seq, CAST(sum(ct) AS BIGINT) AS ct FROM spelled GROUP BY ALL",
    "tally_bqs": f"WITH {CALLS_SQL} SELECT sample, tid, pos, base, qual, strand, count(*) AS ct FROM calls GROUP BY ALL",
    "base_counts": f"WITH {BASES_SQL} SELECT * FROM bases",
    "overlap_offset": f"WITH RECURSIVE {OFFSET_SQL} SELECT fragment, CAST(off AS INTEGER) AS off, CAST(support AS BIGINT) AS support FROM best WHERE k = 1",
    "overlap_quality": f"""WITH RECURSIVE {OFFSET_SQL}, p AS (
  SELECT x.fragment, x.seq AS s0, y.seq AS s1, x.qual AS b0, y.qual AS b1, best.off AS off FROM a x JOIN b y ON x.fragment = y.fragment JOIN best ON best.fragment = x.fragment AND best.k = 1
), z AS (
  SELECT fragment, i, i - off AS j, (b0 + i * 7) % 45 AS q0, CASE WHEN i - off BETWEEN 0 AND 23 THEN (b1 + (i - off) * 7) % 45 END AS q1, substr(s0, CAST(i + 1 AS BIGINT), 1) = substr(s1, CAST(i - off + 1 AS BIGINT), 1) AS same
  FROM (SELECT *, unnest(range(0, 24)) AS i FROM p)
), y AS (
  SELECT fragment, q0, q1, CASE WHEN q1 IS NULL THEN q0 WHEN (NOT same AND least(q0, q1) >= 20) OR q0 <= q1 THEN 0 ELSE q0 END AS n0,
    CASE WHEN q1 IS NULL THEN 0 WHEN (NOT same AND least(q0, q1) >= 20) OR q1 < q0 THEN 0 ELSE q1 END AS n1 FROM z
), t AS (SELECT fragment, sum(n0) AS sum0, sum(n1) - coalesce(sum(q1), 0) AS change FROM y GROUP BY fragment),
w AS (SELECT fragment, sum((b1 + i * 7) % 45) AS whole FROM (SELECT *, unnest(range(0, 24)) AS i FROM p) GROUP BY fragment)
SELECT t.fragment, CAST(sum0 AS BIGINT) AS sum0, CAST(whole + change AS BIGINT) AS sum1 FROM t JOIN w ON t.fragment = w.fragment""",
    "dense_loci": f"WITH {LOCI_REF_SQL} SELECT * FROM known",
    "skip_empty_loci": f"WITH {BASES_SQL} SELECT DISTINCT tid, pos FROM bases",
    "sample_align": f"WITH {LOCI_SQL}, {BASES_SQL}, grid AS (SELECT tid, pos, unnest({A.SAMPLES}) AS sample FROM loci) SELECT g.sample, g.tid, g.pos, " + ", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in align.COUNTS) + " FROM grid g LEFT JOIN bases b ON g.sample = b.sample AND g.tid = b.tid AND g.pos = b.pos",
    "ref_pseudo_sample": f"WITH {LOCI_REF_SQL} SELECT tid, pos, " + ", ".join(f"CAST(CASE WHEN ref_base = '{b}' THEN 1000000 ELSE 0 END AS BIGINT) AS {b.lower()}" for b in "ACGT") + ", CAST(0 AS BIGINT) AS n_lo, CAST(1000000 AS BIGINT) AS n_hi, CAST(0 AS BIGINT) AS n_fuzzy, ref_base AS base, 50 AS qual, CAST(1000000 AS BIGINT) AS ct FROM known",
    "pileup_strings": f"WITH {PILE_SQL} SELECT sample, tid, pos, ref_base, n_lo, n_hi, CAST(0 AS BIGINT) AS n_indel, calls, quals FROM pile",
    "pileup_with_indels": f"WITH RECURSIVE {FULL_SQL} SELECT * FROM full_pile",
    "pileup_depths": f"WITH {PILE_SQL} SELECT sample, tid, pos + 1 AS pos, ref_base, n_hi, n_lo FROM pile",
    "majority_base": f"WITH {BASES_SQL} SELECT sample, tid, pos, {_MAJOR} AS major FROM bases",
    "pstats_histogram": f"WITH {BASES_SQL}, " + BQS_SQL.removeprefix(f"{CALLS_SQL}, ") + f", j AS (SELECT q.*, {_MAJOR} AS major FROM bqs q JOIN bases b ON q.sample = b.sample AND q.tid = b.tid AND q.pos = b.pos), h AS (SELECT sample, tid, pos, {_CELLS} FROM j GROUP BY sample, tid, pos) SELECT {_NAMES}, count(*) AS n_loci FROM h GROUP BY {_NAMES}",
    "pair_enumeration": f"WITH {PAIRED_SQL} SELECT * FROM paired",
    "canonical_key": f"WITH {KEYED_SQL} SELECT * FROM named",
    "alpha_pair_survey": f"WITH {KEYED_SQL} SELECT key, count(*) AS ct FROM named GROUP BY key",
    "alpha_survey": f"WITH {BASES_SQL}, k AS (SELECT array_to_string(list_sort([a, c, g, t], 'DESC'), ',') AS key FROM bases) SELECT key, count(*) AS ct FROM k GROUP BY key",
    "survey_topn": f"WITH {KEYED_SQL} SELECT key, count(*) AS ct FROM named GROUP BY key ORDER BY ct DESC, key LIMIT 50",
    "indel_pairs": f"WITH RECURSIVE {INDEL_SQL}, {A.PAIRS_SQL}, u AS (SELECT s1, s2, tid, pos, is_ins, len, seq, ct AS ct1, 0 AS ct2 FROM indels JOIN pairs ON sample = s1 UNION ALL SELECT s1, s2, tid, pos, is_ins, len, seq, 0, ct FROM indels JOIN pairs ON sample = s2) SELECT s1, s2, tid, pos, is_ins, len, seq, CAST(sum(ct1) AS BIGINT) AS ct1, CAST(sum(ct2) AS BIGINT) AS ct2 FROM u GROUP BY ALL",
    "pack_key": f"WITH {BQS_SQL} SELECT sample, tid, pos, base, qual, strand, (CAST(pos AS BIGINT) << 32) | (CAST(tid AS BIGINT) << 12) | (CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 15 END << 8) | (qual << 1) | strand AS packed, ct FROM bqs",
}
