"""From alignments to counts at positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.operators.sequences import TILE, fetch

LOCUS = ["sample", "tid", "pos"]


#: Distinct cigars that are walked apart from the reads and joined by a broadcast.
SHARED = 20_000


def cigar_ops(reads: DataFrame) -> DataFrame:
    """One row for each operation of a read's cigar: op, len, q (in the read), r (on the contig).

    q and r are where the operation begins. M, =, X, I and S advance q; M, =, X, D and N
    advance r. If a count finds at most SHARED distinct cigars, of 1,000 letters at most, each is
    walked once and joined to the reads by a broadcast; else each read walks its own.
    """
    kinds = reads.select("cigar").distinct()
    few, longest = kinds.limit(SHARED + 1).agg(F.count("*"), F.max(F.length("cigar"))).first()
    if few > SHARED or (longest or 0) > 1000:
        return walk_cigars(reads)
    held = kinds.select(F.col("cigar").alias("cigar_"), walked(F.col("cigar"), F.lit(0)).alias("walk_"))
    each = reads.join(F.broadcast(held), F.col("cigar") == F.col("cigar_")).select(*reads.columns, F.inline("walk_").alias("op_", "len_", "q_", "r_"))
    return each.select(*reads.columns, F.col("op_").alias("op"), F.col("len_").alias("len"), F.col("q_").alias("q"), (F.col("pos") + F.col("r_")).alias("r"))


def walk_cigars(reads: DataFrame) -> DataFrame:
    """cigar_ops(), each row by itself."""
    return reads.withColumn("walk_", walked(F.col("cigar"), F.col("pos"))).select("*", F.inline("walk_")).drop("walk_")


def walked(cigar: Column, pos: Column) -> Column:
    """The operations of a cigar that begins at pos, as an array of (op, len, q, r)."""
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(2))
    ops = F.zip_with(lens, kinds, lambda n, op: F.struct(op.alias("op"), n.cast("int").alias("len")))
    empty = F.array().cast("array<struct<op:string,len:int,q:int,r:int>>")
    start = F.struct(F.lit(0).alias("q"), pos.cast("int").alias("r"), empty.alias("done"))

    def step(acc, x):
        row = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["q"].alias("q"), acc["r"].alias("r"))
        return F.struct(
            (acc["q"] + F.when(x["op"].isin("M", "=", "X", "I", "S"), x["len"]).otherwise(0)).alias("q"),
            (acc["r"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0)).alias("r"),
            F.array_append(acc["done"], row).alias("done"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["done"])


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row for each base that M, = or X puts on the contig: sample, tid, pos, base, strand."""
    m = cigar_ops(reads).where(F.col("op").isin("M", "=", "X"))
    return m.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1))).select(
        "sample", "tid", (F.col("r") + F.col("i")).alias("pos"), F.substr("seq", F.col("q") + F.col("i") + 1, F.lit(1)).alias("base"), "strand"
    )


def read_calls(reads: DataFrame) -> DataFrame:
    """sample, tid, pos, base, qual and strand (1 forward) of each base on the contig, for reads with flag and qual (array)."""
    forward = F.when(F.col("flag").bitwiseAND(16) == 0, 1).otherwise(0)
    slim = reads.select("sample", "tid", "pos", "cigar", "seq", "qual", forward.alias("strand"))
    m = cigar_ops(slim).where(F.col("op").isin("M", "=", "X")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    base = F.upper(F.substr("seq", F.col("q") + F.col("i") + 1, F.lit(1)))
    return m.select("sample", "tid", (F.col("r") + F.col("i")).alias("pos"), base.alias("base"), F.get("qual", F.col("q") + F.col("i")).alias("qual"), "strand")


def indel_events(reads: DataFrame) -> DataFrame:
    """One row an insertion or deletion: sample, tid, pos, is_ins, len, seq (null for deletions).

    An insertion stands at the contig base that follows it, a deletion at its first base.
    """
    ops = cigar_ops(reads.where(F.col("cigar").rlike("[ID]"))).where(F.col("op").isin("I", "D"))
    ins = F.col("op") == "I"
    return ops.select(
        "sample", "tid", F.col("r").alias("pos"), ins.alias("is_ins"), "len",
        F.when(ins, F.substr("seq", F.col("q") + 1, F.col("len"))).alias("seq"),
    )


def count_bqs(calls: DataFrame) -> DataFrame:
    """Counts of (base, qual, strand) at each locus of each sample."""
    return calls.groupBy(*LOCUS, "base", "qual", "strand").agg(F.count("*").alias("ct"))


def count_bases(calls: DataFrame, min_qual: int = 5) -> DataFrame:
    """a, c, g, t (quality enough), n_lo, n_hi (ambiguous bases in neither) and n_fuzzy."""
    pure, high = F.col("base").isin("A", "C", "G", "T"), F.col("qual") >= min_qual
    one = lambda test: F.count(F.when(test, 1))
    return calls.groupBy(*LOCUS).agg(
        *[one((F.col("base") == b) & high).alias(b.lower()) for b in "ACGT"],
        one(pure & ~high).alias("n_lo"), one(pure & high).alias("n_hi"), one(~pure).alias("n_fuzzy"),
    )


def count_indels(events: DataFrame) -> DataFrame:
    return events.groupBy(*LOCUS, "is_ins", "len", "seq").agg(F.count("*").alias("ct"))


def indel_sequence(indels: DataFrame, tiles: DataFrame, width: int = TILE) -> DataFrame:
    """Fills the sequence of deletions from tiles of the reference (see sequences.tiles).

    Each distinct deleted span is fetched once, from the tiles that it touches.
    """
    deleted = indels.where(~F.col("is_ins")).select("tid", F.col("pos").alias("beg"), (F.col("pos") + F.col("len")).alias("stop"))
    found = fetch(deleted, tiles, width).select("tid", F.col("beg").alias("pos"), (F.col("stop") - F.col("beg")).alias("len"), F.lit(False).alias("is_ins"), F.col("seq").alias("gone_"))
    joined = indels.join(found, ["tid", "pos", "len", "is_ins"], "left").withColumn("seq", F.coalesce("seq", "gone_"))
    return joined.select(indels.columns)


def mate_pairs(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that overlap their mate, as fragment, a and b (structs of reads), and all others.

    reads: sample, qname, flag, tid, pos, mpos, cigar and more. Mates are paired (flag 1) in a
    proper pair (flag 2), on one contig; the upstream one reaches the other's start. a is the
    upstream read; of two that start together the one with the smaller flag. A read whose
    partner is not there is among the others, as are second reads of a name and side.
    """
    spans = F.expr("aggregate(transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), x -> int(x)), 0, (s, x) -> s + x)")
    proper = ((F.col("flag").bitwiseAND(3)) == 3) & F.col("mpos").isNotNull()
    apart = (F.col("pos") < F.col("mpos")) & (F.col("pos") + spans < F.col("mpos"))
    held = reads.withColumn("may_", F.coalesce(proper & ~apart, F.lit(False)))
    record = F.struct(*[F.col(c) for c in reads.columns])
    lower, upper = F.least("pos", "mpos"), F.greatest("pos", "mpos")
    grouped = held.where("may_").groupBy("sample", "qname", "tid", lower.alias("lower_"), upper.alias("upper_"))
    # Reads of one name at one place are two but for repeats of the whole record.
    sides = grouped.agg(F.array_sort(F.collect_list(F.struct("pos", "flag", record.alias("read")))).alias("reads_"))
    one, two = F.get("reads_", F.lit(0)), F.get("reads_", F.lit(1))
    fits = F.coalesce((F.size("reads_") == 2) & (one["pos"] == F.col("lower_")) & (two["pos"] == F.col("upper_")), F.lit(False))
    named = F.concat_ws(":", "sample", "qname", "tid", "lower_")
    pairs = sides.where(fits).select(named.alias("fragment"), one["read"].alias("a"), two["read"].alias("b"))
    # A downstream read whose upstream mate does not reach it stands alone, like all the rest.
    reach = F.expr("a.pos + aggregate(transform(regexp_extract_all(a.cigar, '([0-9]+)[MDN=X]', 1), x -> int(x)), 0, (s, x) -> s + x)")
    meets = reach >= F.col("b.pos")
    single = held.where(~F.col("may_")).select(reads.columns)
    single = single.union(sides.where(~fits).select(F.explode("reads_").alias("r")).select("r.read.*"))
    single = single.union(pairs.where(~meets).select(F.explode(F.array("a", "b")).alias("r")).select("r.*"))
    return pairs.where(meets), single


def overlap_offset(pairs: DataFrame) -> DataFrame:
    """Offset of read 2 on the fragment, for pairs (fragment, a: struct, b: struct of reads).

    Every overlapping pair of match blocks votes with the shorter length for the difference
    of the unclipped starts; the best supported offset wins, ties go to the smaller. Pairs
    without overlapping blocks are left out.
    """
    def blocks(side: str) -> Column:
        return F.filter(walked(F.col(f"{side}.cigar"), F.col(f"{side}.pos")), lambda x: x["op"].isin("M", "=", "X"))

    # Blocks of both sides come from one row; one shuffle by fragment serves both sums.
    rows = pairs.select("fragment", blocks("a").alias("xs"), blocks("b").alias("ys")).select("fragment", F.explode("xs").alias("x"), "ys")
    both = rows.select("fragment", "x", F.explode("ys").alias("y"))
    meet = (F.col("x.r") < F.col("y.r") + F.col("y.len")) & (F.col("y.r") < F.col("x.r") + F.col("x.len"))
    off = (F.col("y.r") - F.col("y.q")) - (F.col("x.r") - F.col("x.q"))
    found = both.where(meet).select("fragment", off.alias("off"), F.least("x.len", "y.len").alias("n")).repartition("fragment")
    votes = found.groupBy("fragment", "off").agg(F.sum("n").alias("support"))
    best = F.max_by(F.struct("off", "support"), F.struct("support", (-F.col("off")).alias("less")))
    return votes.groupBy("fragment").agg(best.alias("best")).select("fragment", F.col("best.off").alias("off"), F.col("best.support").alias("support"))


def consolidate_overlap(pairs: DataFrame, min_clash: int = 20) -> DataFrame:
    """New qualities q0 and q1 for read pairs (seq0, seq1, q0, q1: array of int, off).

    Over the overlap, equal bases keep the better quality and zero the other; different bases
    that both reach min_clash are both zeroed, else the worse one is.
    """
    def adjust(mine: str, other: str, my_seq: str, other_seq: str, sign: int, first: bool):
        def at(q, i):
            j = i - sign * F.col("off")
            theirs = F.get(F.col(other), j)
            same = F.substr(my_seq, i + 1, F.lit(1)) == F.substr(other_seq, j + 1, F.lit(1))
            worse = q <= theirs if first else q < theirs
            clash = ~same & (F.least(q, theirs) >= min_clash)
            return F.when((j < 0) | theirs.isNull(), q).when(clash | worse, 0).otherwise(q)

        return F.transform(mine, at)

    # Of two equal qualities, the first read's goes.
    return pairs.withColumns({"n0": adjust("q0", "q1", "seq0", "seq1", 1, True), "n1": adjust("q1", "q0", "seq1", "seq0", -1, False)}).drop("q0", "q1").withColumnsRenamed({"n0": "q0", "n1": "q1"})
