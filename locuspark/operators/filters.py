"""Which reads count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the SAM flag bits.
FLAG_BITS = {
    "PAIRED": 0x1, "PROPER_PAIR": 0x2, "UNMAP": 0x4, "MUNMAP": 0x8, "REVERSE": 0x10, "MREVERSE": 0x20,
    "READ1": 0x40, "READ2": 0x80, "SECONDARY": 0x100, "QCFAIL": 0x200, "DUP": 0x400, "SUPPLEMENTARY": 0x800,
}


def parse_flags(text: str) -> int:
    """A flag set given as a number (any C base) or as names joined by commas."""
    try:
        return int(text, 0)
    except ValueError:
        return sum(FLAG_BITS[name.strip().upper()] for name in text.split(","))


def keep_reads(min_mapq: int = 10, require: int = 0, exclude: int = 0) -> Column:
    """Mapping quality and flag test on one read."""
    flag = F.col("flag")
    return (F.col("mapq") >= min_mapq) & (flag.bitwiseAND(require) == require) & (flag.bitwiseAND(exclude) == 0)


def in_read_groups(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Reads whose rg is among groups (rg), and reads without one.

    groups is a hand-written list; the join is left to the optimizer, which broadcasts it by
    its measured size.
    """
    named = reads.where("rg is not null").join(groups.distinct(), "rg", "left_semi").select(reads.columns)
    return named.unionByName(reads.where("rg is null"))


def quality_class(qual: Column, base: Column, min_qual: int = 5) -> Column:
    """hi, lo or fuzzy (an ambiguous base)."""
    return F.when(~base.isin("A", "C", "G", "T"), "fuzzy").when(qual >= min_qual, "hi").otherwise("lo")


def is_pseudo(counts: list[Column], pseudo_depth: int = 1_000_000) -> Column:
    """Counts of the reference as a sample: three zeros and the pseudo depth."""
    zeros = sum(F.when(c == 0, 1).otherwise(0) for c in counts)
    return (zeros == 3) & (sum(counts) == pseudo_depth)
