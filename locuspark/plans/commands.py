"""The composed commands: from reads, a reference and parameters to rows and files.

reads have the columns of sources.formats.READ_SCHEMA, tiles are those of the reference
(sources.formats.read_fasta_tiles), contigs have tid, name and len. Every function returns
lazy DataFrames; write() puts the wanted ones into files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.operators import align, depth, filters, regions, sequences, tally
from locuspark.plans import dist as D
from locuspark.sources import rows
from locuspark.sources.formats import write_tsv


@dataclass(frozen=True)
class ReadConfig:
    """Which reads and loci count. ranges: contig, first, last (1-based, inclusive), or None for all."""

    min_mapq: int = 10
    min_qual: int = 5
    require: int = 0
    exclude: int = 0
    read_groups: DataFrame | None = None
    ranges: DataFrame | None = None


@dataclass(frozen=True)
class DepthConfig:
    """Parameters of the depth commands: window, bins, step between rows, normaliser floor."""

    width: int = 1000
    per_unit: int = 10
    bins: int = 100
    every: int = 1000
    floor: float = 0.1
    contig: str | None = None

    def __post_init__(self):
        if min(self.width, self.per_unit, self.bins, self.every) < 1:
            raise ValueError("width, per_unit, bins and every must be 1 or more")


@dataclass(frozen=True)
class Tallied:
    """Calls and indels of the reads that count, at the loci that count."""

    calls: DataFrame
    indels: DataFrame
    tiles: DataFrame
    config: ReadConfig = field(default_factory=ReadConfig)

    @property
    def bqs(self) -> DataFrame:
        return tally.count_bqs(self.calls)

    @property
    def bases(self) -> DataFrame:
        return tally.count_bases(self.calls, self.config.min_qual)

    def pileup(self) -> DataFrame:
        with_base = sequences.with_reference(self.bqs, self.tiles)
        return align.pileup_strings(with_base, self.indels, self.config.min_qual)


def tallied(reads: DataFrame, contigs: DataFrame, tiles: DataFrame, config: ReadConfig = ReadConfig()) -> Tallied:
    kept = reads.where(filters.keep_reads(config.min_mapq, config.require, config.exclude))
    if config.read_groups is not None:
        kept = filters.in_read_groups(kept, config.read_groups)
    calls, events = tally.read_calls(kept), tally.indel_events(kept)
    if config.ranges is not None:
        wanted = regions.merge_regions(regions.parse_ranges(config.ranges, contigs))
        one = lambda df: regions.overlapping(df.withColumn("stop_", F.col("pos") + 1), wanted, "pos", "stop_", 1).drop("stop_")
        calls, events = one(calls), one(events)
    return Tallied(calls, tally.indel_sequence(tally.count_indels(events), tiles), tiles, config)


def pileup(reads: DataFrame, contigs: DataFrame, tiles: DataFrame, config: ReadConfig = ReadConfig()) -> DataFrame:
    return rows.pileup_rows(tallied(reads, contigs, tiles, config).pileup(), contigs)


def quality_statistics(reads: DataFrame, contigs: DataFrame, tiles: DataFrame, config: ReadConfig = ReadConfig()) -> DataFrame:
    return rows.histogram_rows(align.quality_histogram(tallied(reads, contigs, tiles, config).calls, config.min_qual))


def compare(
    reads: DataFrame, contigs: DataFrame, tiles: DataFrame, pairs: DataFrame, config: D.DistConfig = D.DistConfig(), reading: ReadConfig = ReadConfig(), with_pileup: bool = False
) -> dict[str, DataFrame]:
    """distances, compositions, indels (output rows) and summary (counts of each pair's states)."""
    data = tallied(reads, contigs, tiles, reading)
    names = [f"q_{i}" for i in range(len(config.quantiles))]
    counts = data.bases
    reference = align.reference_counts(sequences.with_reference(align.present_loci(counts), tiles))
    every = counts.unionByName(reference)
    states = D.pair_states(align.sample_pairs(every, pairs, ["a", "c", "g", "t"]), config)
    terms = D.quality_terms(data.bqs, config)
    distances = D.distance_quantiles(states, terms, config)
    compositions = D.compositions(counts, terms, distances, config)
    matched = every.select("sample", "tid", "pos", (F.col("n_lo") + F.col("n_hi")).alias("m"))
    matches = align.sample_pairs(matched, pairs, ["m"]).withColumnsRenamed({"m_1": "m1", "m_2": "m2"})
    indels = D.indel_distances(align.indel_pairs(data.indels, pairs), matches, config)
    pile = data.pileup()
    based = lambda df: sequences.with_reference(df, tiles)
    per_sample = based(compositions).join(pile.select("sample", "tid", "pos", "n_hi", "n_lo", "n_indel"), ["sample", "tid", "pos"])
    made = {
        "distances": rows.distance_rows(based(distances), contigs, names),
        "compositions": rows.composition_rows(per_sample, contigs, names),
        "indels": rows.indel_rows(based(indels), contigs, names),
        "summary": rows.summary_rows(D.pair_summary(states, distances)),
    }
    if with_pileup:
        at = contigs.select(F.col("name").alias("contig"), "tid")
        for name, low in (("distances", False), ("indels", True)):
            placed = made[name].join(at, "contig").withColumn("pos", F.col("pos") - 1)
            shown = rows.with_pileup(placed, pile, ["s1", "s2"], low).withColumn("pos", F.col("pos") + 1)
            made[name] = shown.select(*made[name].columns, *[c for c in shown.columns if c[:3] in ("s1_", "s2_")])
    return made


def write(made: dict[str, DataFrame], paths: dict[str, str | None]) -> list[str]:
    """Writes the frames whose path is given and not the null device; returns their names.

    Of distances, compositions and indels, one at least must be wanted where they are made.
    """
    wanted = [name for name in made if not rows.disabled(paths.get(name))]
    main = {"distances", "compositions", "indels"}
    if main & set(made) and not main & set(wanted):
        raise ValueError("no output: give a path for distances, compositions or indels")
    unknown = set(paths) - set(made)
    if unknown:
        raise ValueError(f"no such output: {sorted(unknown)}")
    for name in wanted:
        write_tsv(made[name], paths[name])
    return wanted


def depth_statistics(track: DataFrame, contigs: DataFrame, samples: DataFrame, config: DepthConfig = DepthConfig()) -> dict[str, DataFrame]:
    """windows (every n-th) and histogram of depth means that are normalised by the average and by the normalisers.

    track: sample, contig, pos, depth (sparse); contigs: contig, len; samples: sample, is_norm,
    avg_depth, haploid (array of contigs).
    """
    if config.contig is not None:
        track, contigs = track.where(F.col("contig") == config.contig), contigs.where(F.col("contig") == config.contig)
    named = [r["sample"] for r in samples.select("sample").collect()]
    whole = depth.dense(depth.known_tracks(track, contigs), contigs, named)
    scaled = depth.globally_normalised(whole, samples.select("sample", "avg_depth"))
    means = depth.sliding_mean(scaled, config.width, F.col("value"), contigs).join(samples.drop("avg_depth"), "sample")
    local = depth.local_normalise(means.withColumn("ploidy", depth.ploidy(F.col("haploid"), F.col("contig"))), config.floor).withColumn("value", F.coalesce("value", F.lit(0.0)))
    kept = ["sample", "contig", "locus", "mean", "local", "value"]
    return {
        "windows": depth.every_nth(local.select(*kept), "locus", config.every),
        "histogram": depth.histogram(local, ["sample", "contig"], "value", config.per_unit, config.bins, True),
    }


def window_average(track: DataFrame, config: DepthConfig = DepthConfig()) -> dict[str, DataFrame]:
    """windows (every n-th) and histogram of trailing means of a sparse track."""
    if config.contig is not None:
        track = track.where(F.col("contig") == config.contig)
    means = depth.trailing_mean(track, config.width)
    return {
        "windows": depth.every_nth(means, "mid", config.every),
        "histogram": depth.histogram(means, ["sample", "contig"], "mean", config.per_unit, config.bins, False),
    }


def histogram_1d(values: DataFrame, tag: str, per_unit: int, units: int) -> DataFrame:
    """tag, bin_center and count of values (value) in bins over [0, units); others are dropped."""
    return depth.histogram(values.withColumn("tag", F.lit(tag)), ["tag"], "value", per_unit, per_unit * units, False)
