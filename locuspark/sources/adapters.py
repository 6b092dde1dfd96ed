"""Views of the driver's relational tables in the schemas of the operators.

The expressions are plain SQL that Spark and DuckDB read alike, so each view is also a common
table expression for the SQL twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS, CONTIG_LENGTH = 3, 200
REF_BASE = "substr('ACGT', CAST(({tid} * 31 + {pos} * 7) % 4 AS INT) + 1, 1)"
_REF = REF_BASE.format(tid="(l_suppkey % 3)", pos="(l_partkey % 200)")

READS = [
    "l_returnflag || l_linestatus AS sample",
    "CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) AS qname",
    "CAST(l_suppkey % 3 AS INT) AS tid",
    "CAST(l_partkey % 200 AS INT) AS pos",
    f"{_REF} AS ref_base",
    f"CASE WHEN l_orderkey % 11 = 0 THEN 'N' WHEN l_orderkey % 5 = 0 THEN substr('ACGT', CAST((l_suppkey + l_partkey + l_linenumber) % 4 AS INT) + 1, 1) ELSE {_REF} END AS base",
    "CAST(floor(l_quantity) AS INT) AS qual",
    "CAST(floor(l_discount * 600 + 0.5) AS INT) AS mapq",
    "CAST(l_linenumber % 2 AS INT) AS strand",
    "CAST((1 - l_linenumber % 2) * 16 AS INT) AS flag",
    "(CASE WHEN l_partkey % 6 = 0 THEN '2S' ELSE '' END) || CAST(4 + l_linenumber AS STRING) || 'M'"
    " || (CASE l_orderkey % 4 WHEN 0 THEN '2I3M' WHEN 1 THEN '1D3M' WHEN 2 THEN '3N3M' ELSE '' END) AS cigar",
    "substr(repeat('ACGT', 10), CAST(l_orderkey % 4 AS INT) + 1, 24) AS seq",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'rg' || CAST(l_suppkey % 5 AS STRING) END AS rg",
    "CAST(l_orderkey AS BIGINT) AS fragment",
]
DEPTH = [
    "CAST(user_id % 4 AS INT) AS sample",
    "event_type AS contig",
    "CAST((day(ts) - 1) * 24 + hour(ts) + 1 AS INT) AS pos",
]
_X = "abs(CAST({e} AS DOUBLE)) + CAST(0.001 AS DOUBLE)"
DEPTH_LENGTH = 720

READS_SQL = f"reads AS (SELECT {', '.join(READS)} FROM lineitem)"
DEPTH_SQL = f"depth AS (SELECT sample, contig, pos, CAST(count(*) AS BIGINT) AS depth FROM (SELECT {', '.join(DEPTH)} FROM events) GROUP BY sample, contig, pos)"
POINTS_SQL = (
    "raw AS (SELECT vec_id, label, " + ", ".join(f"{_X.format(e=f'embedding[{i}]')} AS x{i}" for i in (1, 2, 3, 4)) + " FROM embeddings), "
    "points AS (SELECT vec_id, label, " + ", ".join(f"round(x{i} / (x1 + x2 + x3 + x4), 6) AS p{i}" for i in (1, 2, 3, 4)) + ", CAST(1 + label AS DOUBLE) AS w FROM raw)"
)
REGIONS = [(0, 1, 60), (0, 40, 90), (1, 100, 150), (1, 151, 170), (2, 199, 260)]
REGIONS_SQL = "ranges(tid, first, last) AS (VALUES " + ", ".join(map(str, REGIONS)) + ")"
REGIONS_CLIPPED_SQL = f"{REGIONS_SQL}, regions AS (SELECT tid, first - 1 AS beg, least(last, {CONTIG_LENGTH}) AS stop FROM ranges)"
SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aligned read a line item, with one base of its own beside cigar and seq."""
    return _table(spark, sf_dir, "lineitem").selectExpr(*READS)


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse depth tracks: sample, contig, pos (from 1), depth."""
    return _table(spark, sf_dir, "events").selectExpr(*DEPTH).groupBy("sample", "contig", "pos").agg({"*": "count"}).withColumnRenamed("count(1)", "depth")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the 4-simplex with weights: vec_id, label, p1 .. p4, w."""
    raw = _table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", *[f"{_X.format(e=f'element_at(embedding, {i})')} AS x{i}" for i in (1, 2, 3, 4)]
    )
    return raw.selectExpr("vec_id", "label", *[f"round(x{i} / (x1 + x2 + x3 + x4), 6) AS p{i}" for i in (1, 2, 3, 4)], "CAST(1 + label AS DOUBLE) AS w")


def contigs(spark: SparkSession) -> DataFrame:
    """tid, name, len of the contigs that reads() lies on."""
    return spark.createDataFrame([(i, f"chr{i + 1}", CONTIG_LENGTH) for i in range(CONTIGS)], "tid int, name string, len int")


def regions(spark: SparkSession) -> DataFrame:
    """contig, first, last: 1-based inclusive ranges as in a locus-range file."""
    return spark.createDataFrame([(f"chr{t + 1}", a, b) for t, a, b in REGIONS], "contig string, first int, last int")


def pairs(spark: SparkSession) -> DataFrame:
    """s1, s2: all pairs of the samples, and each sample against REF."""
    both = [(a, b) for i, a in enumerate(SAMPLES) for b in SAMPLES[i + 1 :]] + [(a, "REF") for a in SAMPLES]
    return spark.createDataFrame(both, "s1 string, s2 string")


PAIRS_SQL = "pairs(s1, s2) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for i, a in enumerate(SAMPLES) for b in [*SAMPLES[i + 1 :], "REF"]) + ")"
