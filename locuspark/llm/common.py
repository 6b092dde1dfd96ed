"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, in local mode only.

    On a cluster a folder of one machine would lose what executors write, so there it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="locuspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Paths of the stashes made since recording began, or None.
_recorded: list[str] | None = None


def stash(df: DataFrame, what: str = "stash") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, keeps statistics.

    Lost executors cost nothing that is written, and every later plan sees the size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recording(paths: list[str]):
    """Adds the paths of stashes that are made inside to `paths`."""
    global _recorded
    outer, _recorded = _recorded, paths
    try:
        yield
    finally:
        _recorded = outer
        if outer is not None:
            outer.extend(paths)


def release(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Deletes the stashes in `paths`, all but those that `keep` reads, which stay listed."""
    read = [f"{p}/" for p in keep.inputFiles()] if paths else []
    for path in list(paths):
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in read):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            paths.remove(path)


def slices(batch, rows: int = 256):
    """A batch in slices of a few rows, so that Python holds the texts of one slice at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fresh_name(df: DataFrame, base: str) -> str:
    """base, with underscores in front until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """df, stashed with a number of its own for each row, so that later reads agree on it."""
    return stash(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def if_bounded(df: DataFrame, key: str, rows: int = 20_000, key_bytes: int = 4 << 20) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, else df as it is.

    df is a stashed table; counting it and its key bytes reads one column.
    """
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= key_bytes else df


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """df with the 0-based position of each row in the given global order.

    A range sort numbers rows inside partitions, and prefix sums over one count a
    partition give the bases: no task sees more than one range, however often a leading
    value of the order repeats. The order should be total; full ties are interchangeable.
    """
    mark = fresh_name(df, "_mark")
    held = stash(df.orderBy(*order).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(mark), 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        held.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    return held.join(F.broadcast(bases), part == bases["_part"]).select(
        *[held[c] for c in df.columns],
        (F.col("_base") + F.col(mark).bitwiseAND((1 << 33) - 1)).alias(name),
    )


WORDS_SQL = r"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    edge = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return (
        F.when(text.isNull() | (text == ""), F.lit(0))
        .when(F.size(parts) == 1, F.when(F.element_at(parts, 1) == "", 0).otherwise(1))
        .otherwise(F.size(parts) - edge)
        .cast("long")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest member of each connected component, for every node of an edge.

    edges: columns a, b (long), any direction. Returns node, component. Alternates the
    large-star and small-star steps of Kiveris et al. (2014): each step groups by node and
    keeps at most as many edges as before. Minima, one row a node, are stashed before they
    are joined, so that they are broadcast where that is bounded, and adaptive execution can
    split the rows of a hot node where it is not.
    """
    now = stash(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.where(F.col("b") > F.col("a")).join(if_bounded(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.where(F.col("a") != F.col("b")).distinct(), "stars")
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(if_bounded(least, "a"), "a")
        now = stash(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(F.col("a") != F.col("b"))
            .distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
