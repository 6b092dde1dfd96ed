"""Depth tracks: filling, windows, normalisation and histograms.

Windows run in tiles of positions with the margin a window needs, so that one contig is not
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.codes import bin_center, value_bin
from locuspark.operators.regions import spread_positions

TRACK, TILE = ["sample", "contig"], 1 << 18


def dense(sparse: DataFrame, contigs: DataFrame, samples: list) -> DataFrame:
    """A row for every position from 1 to each contig's len, zero depth in gaps.

    See known_tracks() for depths on contigs that are not listed, which are left out here.
    """
    tracks = contigs.select("contig", "len").withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    grid = spread_positions(tracks, F.lit(1), F.col("len") + 1)
    return grid.join(sparse, [*TRACK, "pos"], "left").select("sample", "contig", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))


def known_tracks(sparse: DataFrame, contigs: DataFrame) -> DataFrame:
    """sparse as it is; a row on a contig that is not listed, or beyond its end, fails the job."""
    known = contigs.select(F.col("contig").alias("known_"), F.col("len").alias("len_"))
    joined = sparse.join(known, sparse["contig"] == F.col("known_"), "left")
    wrong = F.col("known_").isNull() | (F.col("pos") < 1) | (F.col("pos") > F.col("len_"))
    told = F.raise_error(F.concat(F.lit("unknown contig or position: "), F.concat_ws(" ", "contig", "pos")))
    checked = joined.withColumn("pos", F.when(wrong, told.cast(dict(sparse.dtypes)["pos"])).otherwise(F.col("pos")))
    return checked.select(sparse.columns)


def globally_normalised(track: DataFrame, averages: DataFrame) -> DataFrame:
    """depth over the sample's average depth (sample, avg_depth), as `value`."""
    return track.join(averages, "sample").withColumn("value", F.col("depth") / F.col("avg_depth")).drop("avg_depth")


def sparse(track: DataFrame) -> DataFrame:
    return track.where(F.col("depth") != 0)


def _tiled(track: DataFrame, back: int, ahead: int, tile: int) -> DataFrame:
    """Rows with the tiles that need them: `back` positions before a tile, `ahead` behind it."""
    first = F.floor((F.col("pos") - 1 - ahead) / tile)
    last = F.floor((F.col("pos") - 1 + back) / tile)
    return track.withColumn("tile_", F.explode(F.sequence(first, last)))


def _own(tile: int) -> Column:
    return F.col("tile_") == F.floor((F.col("pos") - 1) / tile)


def sliding_mean(track: DataFrame, width: int, value: Column, lengths: DataFrame, tile: int = TILE) -> DataFrame:
    """sample, contig, locus (0-based centre), mean over full windows of a dense track."""
    w = Window.partitionBy(*TRACK, "tile_").orderBy("pos").rowsBetween(0, width - 1)
    rows = _tiled(track.withColumn("v_", value), 0, width - 1, tile).withColumn("mean", F.avg("v_").over(w)).where(_own(tile))
    return rows.join(lengths, "contig").where(F.col("pos") <= F.col("len") - width + 1).select("sample", "contig", (F.col("pos") - 1 + width // 2).alias("locus"), "mean")


def trailing_mean(sparse_track: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """sample, contig, mid, mean: windows that end before each position, gaps as zeros.

    At position p the sum of [max(1, p - width), p - 1] over width stands at
    max(1, p - width / 2); from half a window on, positions up to the track's last are
    windows, and then windows that shrink toward it follow.
    """
    half = width // 2
    last = sparse_track.groupBy(*TRACK).agg(F.max("pos").alias("last"))
    grid = spread_positions(last.select(*TRACK, "last"), F.lit(1), F.col("last") + 1)
    full = grid.join(sparse_track, [*TRACK, "pos"], "left").select(*TRACK, "last", "pos", F.coalesce("depth", F.lit(0)).cast("double").alias("d"))
    order = Window.partitionBy(*TRACK, "tile_").orderBy("pos")
    rows = _tiled(full, width, width, tile).withColumns(
        {"before": F.coalesce(F.sum("d").over(order.rowsBetween(-width, -1)), F.lit(0.0)), "ahead": F.sum("d").over(order.rowsBetween(0, width))}
    ).where(_own(tile))
    moving = rows.where(F.col("pos") - F.greatest(F.lit(1), F.col("pos") - width) >= half).select(
        *TRACK, F.greatest(F.lit(1), F.col("pos") - half).alias("mid"), (F.col("before") / width).alias("mean")
    )
    # The last `width` positions reach the end within `ahead`, less the last depth itself.
    ends = full.where("pos = last").select(*TRACK, F.col("d").alias("end_d"))
    tail = rows.where((F.col("pos") > F.greatest(F.lit(1), F.col("last") - width)) & (F.col("last") - F.col("pos") >= half)).join(ends, TRACK)
    shrinking = tail.select(
        *TRACK, F.least(F.col("last"), F.greatest(F.col("pos") + half, F.lit(1), F.col("last") - half)).alias("mid"), ((F.col("ahead") - F.col("end_d")) / width).alias("mean")
    )
    return moving.union(shrinking)


def ploidy(haploid: Column, contig: Column) -> Column:
    return F.when(F.array_contains(haploid, contig), 0.5).otherwise(1.0)


def local_normalise(windowed: DataFrame, floor: float = 0.1) -> DataFrame:
    """Adds local (mean of the normalisers' mean / ploidy at a locus) and value.

    windowed: sample, contig, locus, mean, ploidy, is_norm. A local average under `floor`
    leaves 0 for means under 0.5.
    """
    local = windowed.groupBy("contig", "locus").agg(F.avg(F.when(F.col("is_norm"), F.col("mean") / F.col("ploidy"))).alias("local"))
    value = F.when((F.col("local") < floor) & (F.col("mean") < 0.5), 0.0).otherwise(F.greatest(F.try_divide("mean", "local"), F.lit(0.0)))
    return windowed.join(local, ["contig", "locus"]).withColumn("value", value)


def histogram(values: DataFrame, keys: list[str], value: str, per_unit: int, n_bins: int, clamp: bool) -> DataFrame:
    """keys, bin_center, count for all bins; values beyond the last are clamped or dropped."""
    bin_ = value_bin(F.col(value), per_unit)
    top = F.lit(n_bins - 1 if clamp else n_bins).cast("long")
    counts = values.groupBy(*keys, F.least(bin_, top).alias("bin")).agg(F.count("*").alias("n_"))
    # At most n_bins + 1 entries a key.
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n_"))).alias("map_"))
    rows = maps.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return rows.select(*keys, bin_center(F.col("bin"), per_unit).alias("bin_center"), F.coalesce(F.try_element_at("map_", "bin"), F.lit(0).cast("long")).alias("count"))


def every_nth(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.where(F.col(column) % n == 0)
