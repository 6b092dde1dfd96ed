"""From raw documents to sampled pieces: five stages, each an operator of locuspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of docs. Empty tables go through. Ids may be null or repeat: all stages decide by rows
or texts. A stage's result is to be written before the next stage is called, which deletes the
tables that earlier stages have kept in the shared folder, but for those that docs reads.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import common, langid, minhash, mixing, pieces, secret_scan


_kept: list[str] = []


def _stage(work):
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _kept, docs)
        with common.recording(_kept):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the corpus is labelled with."""
    return langid.accepted(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, the one with the smallest doc_id, null last."""
    row = common.fresh_name(docs, "row_")
    held = common.with_row_ids(docs, row)
    judged = common.stash(minhash.near_duplicates(held.select(F.col(row).alias("doc_id"), "text")), "judged")
    groups = common.stash(judged.where(~F.col("kept")).select("component_id").distinct(), "groups")
    members = judged.join(common.if_bounded(groups, "component_id"), "component_id", "left_semi").select("component_id", F.col("doc_id").alias("member_"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row)).alias("order_")
    named = held.select(F.col(row).alias("member_"), order).join(members, "member_")
    named = common.stash(named, "named")
    firsts = common.stash(named.groupBy("component_id").agg(F.min("order_").alias("first_")), "firsts")
    gone = named.join(common.if_bounded(firsts, "component_id"), "component_id").where(F.col("order_") != F.col("first_"))
    gone = common.stash(gone.select("member_"), "gone")
    gone = common.if_bounded(gone, "member_", 1_000_000, 8 << 20)
    return held.join(gone, held[row] == gone["member_"], "left_anti").select(docs.columns)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Covers secrets in the texts."""
    return secret_scan.redact(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights."""
    return mixing.mix(docs)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and sampled piece ids."""
    return pieces.sample_pieces(docs, pieces.model_path())


STAGES = [
    ("language ID", language),
    ("near dedup", near_dedup),
    ("secret scan", secrets),
    ("mixing", mixture),
    ("pieces", tokenize),
]
#: SQL can express neither the fitted models nor the sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs, written = common.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with common.recording(written):
            docs = common.stash(made, "stage")
        common.release(spark, written, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
