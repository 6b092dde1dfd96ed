"""Samples side by side at each locus, pileups, histograms and sample pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.codes import call_char, quality_bin, quality_char

PSEUDO_DEPTH, REF, REF_QUAL = 1_000_000, "REF", 50
COUNTS = ["a", "c", "g", "t", "n_lo", "n_hi", "n_fuzzy"]
BASES = "ACGT"


def at_loci(loci: DataFrame, samples: list[str], counts: DataFrame) -> DataFrame:
    """counts of every declared sample at every locus, zeros where there are none."""
    grid = loci.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    filled = grid.join(counts, ["sample", "tid", "pos"], "left")
    return filled.select("sample", "tid", "pos", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def present_loci(counts: DataFrame) -> DataFrame:
    """Loci where any sample has data."""
    return counts.select("tid", "pos").distinct()


def reference_counts(loci: DataFrame) -> DataFrame:
    """The reference as a sample: the pseudo depth on ref_base, zeros on an ambiguous one."""
    one = lambda b: F.when(F.col("ref_base") == b, PSEUDO_DEPTH).otherwise(0).cast("long").alias(b.lower())
    pure = F.col("ref_base").isin(*BASES)
    zero = F.lit(0).cast("long")
    return loci.select(
        F.lit(REF).alias("sample"), "tid", "pos", *[one(b) for b in BASES],
        zero.alias("n_lo"), F.when(pure, PSEUDO_DEPTH).otherwise(0).cast("long").alias("n_hi"), zero.alias("n_fuzzy"),
    )


def reference_bqs(loci: DataFrame) -> DataFrame:
    return loci.select(
        F.lit(REF).alias("sample"), "tid", "pos", F.col("ref_base").alias("base"), F.lit(REF_QUAL).alias("qual"), F.lit(0).alias("strand"),
        F.when(F.col("ref_base").isin(*BASES), PSEUDO_DEPTH).otherwise(0).cast("long").alias("ct"),
    )


def pileup_strings(bqs: DataFrame, indels: DataFrame | None = None, min_qual: int = 5) -> DataFrame:
    """sample, tid, pos, ref_base, n_lo, n_hi, n_indel, calls, quals.

    bqs has ref_base. Calls stand in the order of base, quality and strand, then indels as sign,
    length and letters, deletions first, by length and sequence; n_lo and n_hi count ambiguous
    bases too. indels must have the letters of deletions (see tally.indel_sequence).
    """
    keys = ["sample", "tid", "pos", "ref_base"]
    call = F.expr("repeat(call, CAST(ct AS INT))")
    qual = F.expr("repeat(qchar, CAST(ct AS INT))")
    made = bqs.withColumn("call", call_char(F.col("base"), F.col("ref_base"), F.col("strand"))).withColumn("qchar", quality_char(F.col("qual")))
    piece = F.struct("base", "qual", "strand", call.alias("calls"), qual.alias("quals"))
    out = made.groupBy(*keys).agg(
        F.sort_array(F.collect_list(piece)).alias("parts"),
        F.sum(F.when(F.col("qual") < min_qual, F.col("ct")).otherwise(0)).alias("n_lo"),
        F.sum(F.when(F.col("qual") >= min_qual, F.col("ct")).otherwise(0)).alias("n_hi"),
    )
    strings = [F.array_join(F.col("parts.calls"), ""), F.array_join(F.col("parts.quals"), "")]
    if indels is None:
        return out.select(*keys, "n_lo", "n_hi", F.lit(0).cast("long").alias("n_indel"), strings[0].alias("calls"), strings[1].alias("quals"))
    sign = F.when(F.col("is_ins"), "+").otherwise("-")
    text = F.repeat(F.concat(sign, F.col("len").cast("string"), F.col("seq")), F.col("ct").cast("int"))
    events = indels.groupBy("sample", "tid", "pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("is_ins", "len", "seq", text.alias("text")))), lambda x: x["text"]), "").alias("events"),
        F.sum("ct").alias("n_indel"),
    )
    return out.join(events, ["sample", "tid", "pos"], "left").select(
        *keys, "n_lo", "n_hi", F.coalesce("n_indel", F.lit(0)).alias("n_indel"), F.concat(strings[0], F.coalesce("events", F.lit(""))).alias("calls"), strings[1].alias("quals")
    )


def majority_base(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The base with the largest count; the first of equals, A if all are zero."""
    top = F.greatest(a, c, g, t)
    return F.when(a == top, "A").when(c == top, "C").when(g == top, "G").otherwise("T")


def quality_histogram(calls: DataFrame, min_qual: int = 5) -> DataFrame:
    """n_loci for each pair of binned quality profiles: major_0 .. major_8, minor_0 .. minor_8.

    The major base of a locus is the majority among good qualities; all other calls, also
    ambiguous ones, are minor. One aggregate a locus counts every (base, bin), so calls are
    read and shuffled once; the majority then only picks among its columns.
    """
    keys, bins = ["sample", "tid", "pos"], range(9)
    base, bin_ = F.col("base"), quality_bin(F.col("qual"))
    cells = [F.count(F.when((base == b) & (bin_ == i), 1)).alias(f"{b}{i}_") for b in BASES for i in bins]
    whole = [F.count(F.when(bin_ == i, 1)).alias(f"all{i}_") for i in bins]
    good = [F.count(F.when((base == b) & (F.col("qual") >= min_qual), 1)).alias(f"{b}_") for b in BASES]
    loci = calls.groupBy(*keys).agg(*cells, *whole, *good).withColumn("major", majority_base(*[F.col(f"{b}_") for b in BASES]))
    major = lambda i: F.coalesce(*[F.when(F.col("major") == b, F.col(f"{b}{i}_")) for b in BASES])
    profiles = loci.select(*[major(i).alias(f"major_{i}") for i in bins], *[(F.col(f"all{i}_") - major(i)).alias(f"minor_{i}") for i in bins])
    return profiles.groupBy(*profiles.columns).agg(F.count("*").alias("n_loci"))


def sample_pairs(counts: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of both samples of each declared pair, as <column>_1 and <column>_2.

    pairs is a declared list; the optimizer broadcasts it by its measured size. The second
    sample comes by a join on the locus, which all pairs share.
    """
    one = counts.select("tid", "pos", F.col("sample").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    two = counts.select("tid", "pos", F.col("sample").alias("s2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return one.join(pairs, "s1").join(two, ["tid", "pos", "s2"]).select("s1", "s2", "tid", "pos", *[f"{c}_{i}" for i in (1, 2) for c in columns])


def canonical_pair(one: list[Column], two: list[Column]) -> Column:
    """A pair of count tuples with the bases in canonical order, as array of (c1, c2).

    Any joint permutation of the bases gives the same array: descending by the two counts'
    sum, then by the first count.
    """
    both = F.array(*[F.struct((a + b).alias("total"), a.alias("c1"), b.alias("c2")) for a, b in zip(one, two)])
    return F.transform(F.sort_array(both, asc=False), lambda x: F.struct(x["c1"].alias("c1"), x["c2"].alias("c2")))


def canonical_order(one: list[Column], two: list[Column]) -> Column:
    """Which base, 0 to 3, stands at each place of canonical_pair(); of equal ones the higher first."""
    both = F.array(*[F.struct((a + b).alias("total"), a.alias("c1"), b.alias("c2"), F.lit(i).alias("base")) for i, (a, b) in enumerate(zip(one, two))])
    return F.transform(F.sort_array(both, asc=False), lambda x: x["base"])


def canonical_single(counts: list[Column]) -> Column:
    return F.sort_array(F.array(*counts), asc=False)


def indel_pairs(indels: DataFrame, pairs: DataFrame) -> DataFrame:
    """ct1 and ct2 of every indel that either sample of a pair has at a locus.

    The union of both samples' events as one grouped sum, instead of a full outer join; REF
    has no indels.
    """
    keys = ["tid", "pos", "is_ins", "len", "seq"]
    zero = F.lit(0).cast("long")
    one = indels.join(pairs, indels["sample"] == pairs["s1"]).select("s1", "s2", *keys, F.col("ct").alias("ct1"), zero.alias("ct2"))
    two = indels.join(pairs, indels["sample"] == pairs["s2"]).select("s1", "s2", *keys, zero.alias("ct1"), F.col("ct").alias("ct2"))
    return one.union(two).groupBy("s1", "s2", *keys).agg(F.sum("ct1").alias("ct1"), F.sum("ct2").alias("ct2"))


def top_keys(counted: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest ct."""
    return counted.orderBy(F.desc("ct"), *ties).limit(n)


def rank_of_means(df: DataFrame, *keys: str) -> DataFrame:
    """rank: 0 for the base with the largest mean among the rows of a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), "base")) - 1)
