"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the words of all
documents in that proportion; no target exceeds three times its source's words, and the
excess goes to the others by weight until none is above. Within a source, documents in the
order of (size, doc_id) have equal expected copies, target / source size; their prefix sums
plus one offset of the source cross integers, and each crossing emits the document once, but
no document more than its expected copies rounded up, which bounds what rounding of the sums
could add. The order by size makes neighbours alike, which keeps the words taken close to the target.

Null texts have size 0; a source without words takes nothing. Rows alike in source, size and
doc_id stand next to each other in that order and are counted like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import fresh_name, if_bounded, numbered, stash, table, with_row_ids, word_count

MOST, SEED = 3, 7


def _offset(index: Column, seed: int) -> Column:
    """In [0, 1), a multiple of 2 ** -31."""
    return ((index * 1103515245 + seed * 12345 + 12345) % 2147483648) / F.lit(2147483648.0)


def source_targets(sized: DataFrame) -> DataFrame:
    """source, first (row number of its first document), source_size, target, rate, offset."""
    stats = sized.groupBy("source").agg(F.min("row_number").alias("first"), F.sum("size").alias("source_size"))
    ranked = stash(
        numbered(stats, F.col("source").asc_nulls_last(), name="index").withColumn("weight", F.col("index") % 3 + 1), "sources"
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    size, weight = F.col("source_size"), F.col("weight")
    level, capped = 0.0, -1
    while True:  # each pass caps at least one more source or ends; a pass is one aggregate
        above = weight * F.lit(level) > MOST * size
        full, rest, n = ranked.agg(
            F.sum(F.when(above, MOST * size).otherwise(0)), F.sum(F.when(above, 0).otherwise(weight)), F.count(F.when(above, 1))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - full) / rest
    target = F.least(weight * F.lit(float(level)), (MOST * size).cast("double"))
    return ranked.select(
        "source", "first", "source_size", target.alias("target"),
        F.when(size > 0, target / size).otherwise(0.0).alias("rate"),
        _offset(F.col("index"), SEED).alias("offset"),
    )


def mix_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and carried for every row of docs."""
    # Stashed, as the range sort reads its input twice, and words are to be counted once.
    slim = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried), "sizes")
    sized = numbered(slim, F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), *map(F.col, carried))
    sources = stash(source_targets(sized), "targets")
    rows = sized.join(if_bounded(sources, "source"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    place = F.col("row_number") - F.col("first")
    crossed = F.floor((place + 1) * F.col("rate") + F.col("offset")) - F.floor(place * F.col("rate") + F.col("offset"))
    return rows.withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs."""
    row, copies, again = (fresh_name(docs, c) for c in ("mix_row_", "copies_", "again_"))
    held = with_row_ids(docs, row)
    counts = mix_counts(held, row).where("copies > 0").select(F.col(row).alias("r_"), F.col("copies").alias(copies))
    joined = held.join(counts, held[row] == counts["r_"])
    return joined.select(*[held[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(again)).drop(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": query}
ORACLES = {
    "op8_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (SELECT *, i % 3 + 1 AS w FROM s),
o AS (
  SELECT *, CAST(coalesce(sum({MOST} * z) OVER q, 0) AS BIGINT) AS full_, CAST(sum(w) OVER (ORDER BY {MOST} * z / w DESC, i DESC) AS BIGINT) AS rest, CAST(sum(z) OVER () AS BIGINT) AS total
  FROM w WINDOW q AS (ORDER BY {MOST} * z / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT arg_min(CAST(total - full_ AS DOUBLE) / rest, {MOST} * z / w) AS level FROM o WHERE w * (CAST(total - full_ AS DOUBLE) / rest) <= {MOST} * z
), t AS (
  SELECT source, z AS source_size, least(w * level, CAST({MOST} * z AS DOUBLE)) AS target, ((i * 1103515245 + {SEED} * 12345 + 12345) % 2147483648) / 2147483648.0::DOUBLE AS u FROM w, v
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor((k + 1) * rate + u) - floor(k * rate + u), ceil(rate)) AS BIGINT) * size AS taken FROM r
"""
}
