"""Sequences and quality strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions.codes import FASTQ_RANGES

#: Letters in a tile of a reference sequence.
TILE = 16384


def substrings(loci: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, pos (0-based), seq of `n` bases from pos, for loci (contig, pos, n) on contigs (contig, text)."""
    return loci.join(contigs, "contig").select("contig", "pos", F.substr("text", F.col("pos") + 1, F.col("n")).alias("seq"))


def tiles(contigs: DataFrame, width: int = TILE) -> DataFrame:
    """tid, tile, seq: contigs (tid, ref) in pieces of `width` letters, the last one shorter."""
    n = F.ceil(F.length("ref") / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("tile"), F.substr("ref", i * width + 1, F.lit(width)).alias("seq")))
    return contigs.where("length(ref) > 0").select("tid", F.inline(parts))


def fetch(spans: DataFrame, tiles: DataFrame, width: int = TILE) -> DataFrame:
    """tid, beg, stop and seq for each distinct span (tid, beg, stop), 0-based and half-open.

    A span meets only the tiles it touches, so that no row holds a contig. What lies beyond a
    contig's end is left out; spans that lie there wholly, or are empty, have no row.
    """
    first, last = F.floor(F.col("beg") / width).cast("int"), F.floor((F.col("stop") - 1) / width).cast("int")
    touched = spans.select("tid", "beg", "stop").where("beg < stop and beg >= 0").distinct().withColumn("tile", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("beg") - F.col("tile") * width, F.lit(0)).cast("int")
    hi = F.least(F.col("stop") - F.col("tile") * width, F.lit(width)).cast("int")
    cut = touched.join(tiles, ["tid", "tile"]).select("tid", "beg", "stop", F.struct("tile", F.substr("seq", lo + 1, hi - lo).alias("seq")).alias("part"))
    return cut.groupBy("tid", "beg", "stop").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["seq"]), "").alias("seq")).where("seq <> ''")


def with_reference(loci: DataFrame, tiles: DataFrame, width: int = TILE) -> DataFrame:
    """loci (tid, pos, ...) with ref_base, N where the reference does not reach."""
    named = loci.withColumn("tile", F.floor(F.col("pos") / width).cast("int"))
    base = F.substr("seq", (F.col("pos") - F.col("tile") * width + 1).cast("int"), F.lit(1))
    return named.join(tiles, ["tid", "tile"], "left").select(*loci.columns, F.coalesce(F.nullif(F.upper(base), F.lit("")), F.lit("N")).alias("ref_base"))


def quality_flavours(records: DataFrame, *keys: str) -> DataFrame:
    """Which FASTQ flavours all quality characters of a group of records fit, by name.

    Only the extreme characters matter, so that a grouped min and max decide.
    """
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c))
    ends = records.where("qual <> ''").select(*keys, F.array_min(codes).alias("lo"), F.array_max(codes).alias("hi"))
    ends = ends.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = [((F.col("lo") >= ord(a)) & (F.col("hi") < ord(b))).alias(name) for name, (a, b) in FASTQ_RANGES.items()]
    return ends.select(*keys, *fits)


def recode_quality(qual: Column, shift: int) -> Column:
    """Every quality character moved by shift, not below the code 0."""
    moved = F.transform(F.split(qual, ""), lambda c: F.chr(F.greatest(F.lit(0), F.ascii(c) + shift).cast("long")))
    return F.when(qual == "", qual).otherwise(F.array_join(moved, ""))


def flavour(fits: DataFrame, *keys: str) -> DataFrame:
    """keys and flavour: Sanger, or the first of the 64-based ones; a group that fits none, or both kinds, fails.

    fits: as of quality_flavours().
    """
    other = [n for n in FASTQ_RANGES if n != "Sanger"]
    wide = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in other])
    unclear = F.raise_error(F.concat(F.lit("quality flavour is not clear: "), F.concat_ws(" ", *keys))).cast("string")
    named = F.when(F.col("Sanger") & wide.isNull(), "Sanger").when(~F.col("Sanger") & wide.isNotNull(), wide).otherwise(unclear)
    return fits.select(*keys, named.alias("flavour"))
