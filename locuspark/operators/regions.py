"""Half-open intervals (tid, beg, stop) on contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bin of the range joins, the tile of the usual alignment indexes.
TILE = 1 << 14


def parse_ranges(ranges: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, first, last), 1-based inclusive, as (tid, beg, stop) clipped to the contig.

    Unknown contigs and empty or non-positive ranges fail the job.
    """
    named = ranges.join(contigs, ranges["contig"] == contigs["name"], "left")
    wrong = F.col("tid").isNull() | (F.col("first") < 1) | (F.col("last") < F.col("first"))
    told = F.raise_error(F.concat(F.lit("bad range: "), F.concat_ws(" ", "contig", "first", "last")))
    return named.select(F.when(wrong, told.cast("int")).otherwise(F.col("tid")).alias("tid"), (F.col("first") - 1).alias("beg"), F.least("last", "len").alias("stop"))


def whole_contigs(contigs: DataFrame) -> DataFrame:
    return contigs.select("tid", F.lit(0).alias("beg"), F.col("len").alias("stop"))


def merge_regions(regions: DataFrame) -> DataFrame:
    """Overlapping intervals joined; intervals that only touch stay apart."""
    before = Window.partitionBy("tid").orderBy("beg", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("tid").orderBy("beg", "stop").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("beg") < F.max("stop").over(before), 0).otherwise(1)
    return (
        regions.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(upto))
        .groupBy("tid", "island")
        .agg(F.min("beg").alias("beg"), F.max("stop").alias("stop"))
        .drop("island")
    )


def _tiled(df: DataFrame, beg: str, stop: str, tile: int) -> DataFrame:
    first, last = F.floor(F.col(beg) / tile), F.floor((F.greatest(F.col(stop), F.col(beg) + 1) - 1) / tile)
    return df.withColumn("tile_", F.explode(F.sequence(first, last)))


def intersect_regions(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Every non-empty intersection of an interval of a with one of b.

    An equi-join on (tid, tile); a pair that shares tiles is kept in the tile where the
    intersection begins.
    """
    left = _tiled(a.select("tid", F.col("beg").alias("a0"), F.col("stop").alias("a1")), "a0", "a1", tile)
    right = _tiled(b.select("tid", F.col("beg").alias("b0"), F.col("stop").alias("b1")), "b0", "b1", tile)
    beg, stop = F.greatest("a0", "b0"), F.least("a1", "b1")
    return left.join(right, ["tid", "tile_"]).where((beg < stop) & (F.floor(beg / tile) == F.col("tile_"))).select("tid", beg.alias("beg"), stop.alias("stop"))


def overlapping(rows: DataFrame, regions: DataFrame, beg: str, stop: str, longest: int, tile: int = TILE) -> DataFrame:
    """Rows whose [beg, stop) meets a region. No row is longer than `longest`.

    Regions are tiled with that margin in front, so each row stays in the one tile it begins in.
    """
    wide = _tiled(regions.select("tid", F.greatest(F.col("beg") - longest, F.lit(0)).alias("w0"), "beg", "stop"), "w0", "stop", tile)
    wide = wide.select(F.col("tid").alias("r_tid"), F.col("tile_").alias("r_tile"), F.col("beg").alias("r_beg"), F.col("stop").alias("r_stop"))
    meet = (rows["tid"] == wide["r_tid"]) & (F.floor(rows[beg] / tile) == wide["r_tile"]) & (rows[beg] < wide["r_stop"]) & (rows[stop] > wide["r_beg"])
    return rows.join(wide, meet, "left_semi")


def span_of_size(regions: DataFrame, most: int) -> DataFrame:
    """The first `most` loci of merged regions in order: whole regions, the last one cut."""
    # Regions are few beside loci; their running length needs one order over all of them.
    upto = Window.orderBy("tid", "beg").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("stop") - F.col("beg")).over(upto), F.lit(0))
    return (
        regions.withColumn("before", before)
        .where(F.col("before") < most)
        .select("tid", "beg", F.least(F.col("stop"), F.col("beg") + (most - F.col("before"))).cast("int").alias("stop"))
    )


def spread_positions(df: DataFrame, beg: Column, stop: Column, name: str = "pos", tile: int = TILE) -> DataFrame:
    """df with a row for each position of [beg, stop).

    Spans are cut into tiles, which are dealt over tasks before positions come of them, so that
    neither a row nor a task holds a contig's positions.
    """
    kind = dict(df.select(beg.alias("b_")).dtypes)["b_"]
    cut = df.withColumns({"beg_": beg.cast("long"), "stop_": stop.cast("long")}).where("beg_ < stop_")
    cut = cut.withColumn("tile_", F.explode(F.sequence(F.floor(F.col("beg_") / tile), F.floor((F.col("stop_") - 1) / tile)))).repartition(*df.columns, "tile_")
    first, last = F.greatest("beg_", F.col("tile_") * tile), F.least("stop_", (F.col("tile_") + 1) * tile)
    return cut.select(*df.columns, F.explode(F.sequence(first.cast(kind), (last - 1).cast(kind))).alias(name))


def loci(regions: DataFrame) -> DataFrame:
    """Every (tid, pos) of merged regions."""
    return spread_positions(regions.select("tid", "beg", "stop"), F.col("beg"), F.col("stop")).select("tid", "pos")


def count_loci(regions: DataFrame) -> DataFrame:
    return regions.agg(F.coalesce(F.sum((F.col("stop") - F.col("beg")).cast("long")), F.lit(0)).alias("n_loci"))
