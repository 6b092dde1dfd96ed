"""Tallies that follow a growing folder of reads.

A batch of new files is tallied by itself and appended with its batch number; a reader sums
the parts. Writing a batch again replaces it, so that a restarted query counts nothing twice.
Mates of a fragment wait in state until both are there or the stream ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locuspark.operators import filters, tally

KEYS, COUNTS = ["sample", "tid", "pos"], ["a", "c", "g", "t", "n_lo", "n_hi", "n_fuzzy"]


def stream_base_counts(spark: SparkSession, reads_path: str, schema: str, out: str, checkpoint: str, min_mapq: int = 10) -> StreamingQuery:
    """Starts a query that tallies all files not seen yet, then stops."""
    def write(batch: DataFrame, number: int) -> None:
        counts = tally.count_bases(batch.where(filters.keep_reads(min_mapq)))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    reads = spark.readStream.schema(schema).parquet(reads_path)
    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_base_counts(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.parquet(out)
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def complete_up_to(starts: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows that no later read can change: those before the last start of every sample's reads.

    starts: sample, tid, pos of tallied loci; loaded: sample, tid, pos of the reads seen so far,
    which come in order. A sample without reads holds nothing back.
    """
    last = loaded.groupBy("sample").agg(F.max(F.struct("tid", "pos")).alias("last_")).agg(F.min("last_").alias("last_"))
    # One row.
    return starts.join(F.broadcast(last), F.struct("tid", "pos") < F.col("last_"), "left_semi")


def pair_mates(reads: DataFrame) -> DataFrame:
    """fragment, pos1, pos2 as soon as a fragment's second read (fragment, pos) arrives."""
    def match(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [state.get[0]] if state.exists else []
        for pdf in pdfs:
            for pos in pdf["pos"]:
                if held:
                    first = held.pop()
                    yield pd.DataFrame({"fragment": [key[0]], "pos1": [min(first, pos)], "pos2": [max(first, pos)]})
                else:
                    held.append(int(pos))
        if held:
            state.update((held[0],))
        elif state.exists:
            state.remove()

    return reads.groupBy("fragment").applyInPandasWithState(match, "fragment string, pos1 int, pos2 int", "pos int", "append", "NoTimeout")
