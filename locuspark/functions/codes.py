"""Bases, qualities and bins as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 4-bit base codes of the BAM format, by letter.
NT16 = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
# Quality bins are five wide, and qualities of 44 and more share the last.
BIN_WIDTH, BIN_TOP = 5, 44
# Lowest legal quality character and upper bound of each FASTQ flavour.
FASTQ_RANGES = {"Sanger": ("!", "J"), "Solexa": (";", "i"), "Illumina13": ("@", "i"), "Illumina15": ("B", "i")}
# Number that a flavour adds to a quality for its character.
FASTQ_OFFSETS = {"Sanger": 33, "Solexa": 64, "Illumina13": 64, "Illumina15": 64}


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / F.lit(10.0))


def error_quality(p: Column) -> Column:
    """Nearest whole quality of an error probability; halves go down."""
    q = F.lit(-10.0) * F.log10(p)
    return F.when(F.ceil(q) - q < q - F.floor(q), F.ceil(q)).otherwise(F.floor(q)).cast("int")


def quality_char(quality: Column, offset: int = 33) -> Column:
    return F.chr((quality + offset).cast("long"))


def char_quality(c: Column, offset: int = 33) -> Column:
    return F.ascii(c) - offset


def flavour_offset(flavour: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, offset in FASTQ_OFFSETS.items():
        out = F.when(flavour == name, offset).otherwise(out)
    return out


def call_char(base: Column, ref_base: Column, strand: Column) -> Column:
    """Pileup letter: . and , for a match, else the base, lower case on the reverse strand."""
    return F.when(base == ref_base, F.when(strand == 1, ".").otherwise(",")).otherwise(F.when(strand == 1, base).otherwise(F.lower(base)))


def nt16(base: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NT16.items() for x in kv]), F.upper(base))


def nt4(base: Column) -> Column:
    """0 to 3 for A, C, G and T, 4 for others."""
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(4)


def quality_bin(quality: Column) -> Column:
    return F.floor(F.least(quality, F.lit(BIN_TOP)) / BIN_WIDTH).cast("int")


def value_bin(value: Column, per_unit: int) -> Column:
    return F.floor(value * per_unit).cast("long")


def bin_center(bin_: Column, per_unit: int) -> Column:
    return (2 * bin_ + 1) / F.lit(2.0 * per_unit)


def pack_key(pos: Column, tid: Column, base: Column, qual: Column, strand: Column) -> Column:
    """A tally key in 64 bits: pos 32, tid 20, base 4, qual 7, strand 1."""
    out = F.shiftleft(pos.cast("long"), 32)
    for value, shift in ((tid, 12), (base, 8), (qual, 1), (strand, 0)):
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), shift))
    return out


def unpack_key(key: Column) -> Column:
    """pos, tid, base, qual and strand of a tally key, as a struct."""
    part = lambda shift, bits: F.shiftrightunsigned(key, shift).bitwiseAND((1 << bits) - 1).cast("int")
    return F.struct(part(32, 32).alias("pos"), part(12, 20).alias("tid"), part(8, 4).alias("base"), part(1, 7).alias("qual"), part(0, 1).alias("strand"))


# Bits of the four counts in a packed key, largest count first.
ALPHA_BITS = (24, 20, 12, 8)


def pack_counts(counts: list[Column], bits: tuple[int, ...] = ALPHA_BITS) -> Column:
    """Four counts in 64 bits; null where one needs more bits than it has, so that no keys collide."""
    out, left = F.lit(0).cast("long"), sum(bits)
    fits = F.lit(True)
    for count, n in zip(counts, bits):
        left -= n
        out = out.bitwiseOR(F.shiftleft(count.cast("long"), left))
        fits = fits & (count >= 0) & (count < (1 << n))
    return F.when(fits, out)


def unpack_counts(key: Column, bits: tuple[int, ...] = ALPHA_BITS) -> Column:
    """The counts of a packed key, as an array."""
    out, left = [], sum(bits)
    for n in bits:
        left -= n
        out.append(F.shiftrightunsigned(key, left).bitwiseAND((1 << n) - 1))
    return F.array(*out)


def char_codes(text: Column, letters: str, unknown: int = -1) -> Column:
    """The place of each character of a text among letters, or unknown; an empty text has no characters."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.when(F.position(c, F.lit(letters)) > 0, F.position(c, F.lit(letters)) - 1).otherwise(unknown))


def code_counts(text: Column, letters: str, unknown: int = -1) -> Column:
    """How many characters of a text have each code of char_codes(), as an array of (code, n) without zeros.

    Texts are not taken apart, so that long ones need no arrays; a null text has no characters.
    letters: each once.
    """

    def counts(known: Column) -> Column:
        places = [F.length(known) - F.length(F.replace(known, F.lit(c), F.lit(""))) for c in letters]
        return F.array(*[F.struct(F.lit(i).alias("code"), n.cast("long").alias("n")) for i, n in [*enumerate(places), (unknown, F.length(text) - F.length(known))]])

    # A lambda's argument is computed once.
    found = F.transform(F.array(F.regexp_replace(text, f"[^{re.escape(letters)}]+", "")), counts)[0]
    return F.filter(found, lambda x: x["n"] > 0)


def short_contig(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)^chr", "")
