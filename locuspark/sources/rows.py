"""Formatted output rows: the public contract of the text outputs, in their column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbers(columns: list[str], pattern: str) -> list:
    return [F.format_string(pattern, F.col(c).cast("double")).alias(c) for c in columns]


def pileup_rows(pile: DataFrame, contigs: DataFrame) -> DataFrame:
    """sample, contig, pos (from 1), ref_base, n_hi, calls, quals."""
    return pile.join(contigs, "tid").select("sample", F.col("name").alias("contig"), (F.col("pos") + 1).alias("pos"), "ref_base", "n_hi", "calls", "quals")


def distance_rows(distances: DataFrame, contigs: DataFrame, quantiles: list[str]) -> DataFrame:
    """s1, s2, contig, pos (from 1), ref_base, quantiles to four digits."""
    named = distances.join(contigs, "tid").select("s1", "s2", F.col("name").alias("contig"), (F.col("pos") + 1).alias("pos"), "ref_base", *quantiles)
    return named.select("s1", "s2", "contig", "pos", "ref_base", *numbers(quantiles, "%7.4f"))


def composition_rows(comps: DataFrame, contigs: DataFrame, quantiles: list[str]) -> DataFrame:
    """sample, contig, pos, ref_base, hi, lo, indels, base, rank, mean and quantiles to eight digits."""
    named = comps.join(contigs, "tid").withColumn("contig", F.col("name")).withColumn("pos", F.col("pos") + 1)
    return named.select("sample", "contig", "pos", "ref_base", "n_hi", "n_lo", "n_indel", "base", "rank", *numbers(["mean", *quantiles], "%10.8f"))


def indel_rows(distances: DataFrame, contigs: DataFrame, quantiles: list[str]) -> DataFrame:
    """s1, s2, contig, ref_base, pos, quantiles to four digits, both samples' counts, events.

    Match counts and the match event, @, stand first.
    """
    named = distances.join(contigs, "tid").withColumn("contig", F.col("name")).withColumn("pos", F.col("pos") + 1)
    return named.select("s1", "s2", "contig", "ref_base", "pos", *numbers(quantiles, "%.4f"), "counts1", "counts2", "events")


def sparse_depth_rows(track: DataFrame) -> DataFrame:
    """contig, pos, depth with four decimals; zeros are left out."""
    return track.where(F.col("depth") != 0).select("sample", "contig", "pos", F.format_string("%6.4f", F.col("depth").cast("double")).alias("depth"))


def numerical_cdfs(points: DataFrame, dims: list[str], order: str, buckets: int = 64) -> DataFrame:
    """dim, rank (from 0) and value of each point in each dimension.

    Values are dealt into buckets by approximate quantiles, a fixed number a dimension; a row's
    rank is its place in its bucket after the rows of the buckets before, so that a dimension
    is not one task. Rows with the same value share a bucket.
    """
    from pyspark.sql import Window

    splits = points.approxQuantile(dims, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    bucket = lambda i: F.aggregate(F.array(*[F.lit(float(x)) for x in sorted(set(splits[i]))] or [F.lit(0.0)]), F.lit(0), lambda n, x: n + (F.col(dims[i]) > x).cast("int"))
    cells = F.array(*[F.struct(F.lit(i).alias("dim"), bucket(i).alias("bucket"), F.col(d).alias("value")) for i, d in enumerate(dims)])
    long = points.select(order, F.inline(cells))
    counts = long.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("dim", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("dim", "bucket").orderBy("value", order)) - 1
    # At most `buckets` rows a dimension.
    return long.withColumn("within", within).join(F.broadcast(before), ["dim", "bucket"]).select(order, "dim", "value", (F.col("within") + F.col("before")).cast("int").alias("rank"))


def disabled(path: str | None) -> bool:
    """Whether an output is not wanted: no path, an empty one, or the null device."""
    return path is None or path in ("", "/dev/null")


def with_pileup(rows: DataFrame, pile: DataFrame, sides: list[str], low: bool = False) -> DataFrame:
    """rows with the pileup fields of the samples in the columns `sides`.

    <side>_n_hi, <side>_n_lo and <side>_n_indel if `low`, <side>_calls and <side>_quals; the
    reference has its pseudo depth and the word REF, a sample without data zeros and nothing. rows: tid and pos (0-based) with `sides`.
    """
    from locuspark.operators.align import PSEUDO_DEPTH, REF

    named = ["n_hi", *(["n_lo", "n_indel"] if low else []), "calls", "quals"]
    of_ref = {"n_hi": F.lit(PSEUDO_DEPTH).cast("long"), "n_lo": F.lit(0).cast("long"), "n_indel": F.lit(0).cast("long"), "calls": F.lit(REF), "quals": F.lit(REF)}
    out = rows
    for side in sides:
        mine = pile.select(F.col("sample").alias(side), "tid", "pos", *[F.col(c).alias(f"{side}_{c}") for c in named])
        out = out.join(mine, [side, "tid", "pos"], "left")
        none = lambda c: F.lit("") if c in ("calls", "quals") else F.lit(0).cast("long")
        out = out.withColumns({f"{side}_{c}": F.when(F.col(side) == REF, of_ref[c]).otherwise(F.coalesce(f"{side}_{c}", none(c))) for c in named})
    return out.select(*rows.columns, *[f"{side}_{c}" for side in sides for c in named])


def summary_rows(summary: DataFrame) -> DataFrame:
    """s1, s2 and the eight counts of each pair, as in the pair-summary file."""
    return summary.orderBy("s1", "s2")


def histogram_rows(histogram: DataFrame) -> DataFrame:
    """The binned quality profiles and their number of loci, in the order of the profiles."""
    cells = [c for c in histogram.columns if c != "n_loci"]
    return histogram.select(*cells, "n_loci").orderBy(*cells)
