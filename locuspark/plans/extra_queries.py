"""Queries on lookups, formatted rows and generated data, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from locuspark.functions import codes, counting
from locuspark.functions import posterior as P
from locuspark.operators import lookup, simulate
from locuspark.plans import loci_queries as L
from locuspark.plans import value_queries as V
from locuspark.sources import adapters as A
from locuspark.sources import rows

ORDER = [2, 0, 3, 1]


def _bounds(s, d):
    p = A.points(s, d)
    return lookup.bounds(p.select("label", "vec_id", F.col("p2").alias("x")), p.select("label", F.col("p1").alias("x")), "label", "x").select("label", "vec_id", "x", "lower", "upper")


def _permuted(s, d):
    p = A.points(s, d).select("vec_id", F.array("p1", "p2", "p3", "p4").alias("p"))
    there = p.select("vec_id", lookup.permute(F.col("p"), ORDER).alias("q"))
    back = there.select("vec_id", "q", lookup.permute(F.col("q"), lookup.inverse(ORDER)).alias("p"))
    return back.select("vec_id", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(4)], *[F.col("p")[i].alias(f"p{i + 1}") for i in range(4)])


def _distance_table(s, d):
    """States over a grid of count pairs."""
    grid = s.range(0, 12).select(F.array(F.col("id"), F.lit(2), F.lit(0), F.lit(0)).cast("array<bigint>").alias("c1"))
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("c1", F.array(F.lit(2), F.col("k"), F.lit(0), F.lit(0)).cast("array<bigint>").alias("c2"))

    config = V.CONFIG

    def run(batches):
        for pdf in batches:
            both = [(np.array(a) + config.prior, np.array(b) + config.prior) for a, b in zip(pdf.c1, pdf.c2)]
            found = P.compare_all(both, config.threshold, config.confidence, config.points)
            yield pd.DataFrame({"a": [int(c[0]) for c in pdf.c1], "b": [int(c[1]) for c in pdf.c2], "state": [f[0] for f in found]})

    return grid.mapInPandas(run, "a int, b int, state string")


def _scalars(s, d):
    li = A._table(s, d, "lineitem")
    t = F.col("l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", counting.elapsed(t).alias("elapsed"), counting.strict_number(F.col("l_linenumber").cast("string")).alias("number"),
        codes.short_contig(F.concat(F.lit("Chr"), F.col("l_suppkey").cast("string"))).alias("short"), codes.nt4(F.substr(F.lit("ACGTN"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1))).alias("nt4"),
        codes.flavour_offset(F.lit("Solexa")).alias("offset"),
    )


QUERIES = {
    "virtual_bounds": _bounds,
    "depermute_points": _permuted,
    "ordered_cdf": lambda s, d: lookup.ordered_cdf(A.points(s, d), ["label"], "p1", "w").select("vec_id", F.round("cdf", 6).alias("cdf")),
    "numerical_cdfs": lambda s, d: rows.numerical_cdfs(A.points(s, d), ["p1", "p2", "p3", "p4"], "vec_id"),
    "pileup_rows": lambda s, d: rows.pileup_rows(L._pileup_full(s, d), A.contigs(s)),
    "sparse_depth_rows": lambda s, d: rows.sparse_depth_rows(A.depth(s, d)),
    "composition_rows": lambda s, d: rows.composition_rows(
        L.with_ref(V._composition(s, d)).join(L._pileup_full(s, d).select("sample", "tid", "pos", "n_hi", "n_lo", "n_indel"), ["sample", "tid", "pos"]), A.contigs(s), [f"q_{i}" for i in range(5)]
    ),
    "distance_rows": lambda s, d: rows.distance_rows(L.with_ref(V._distance(s, d)), A.contigs(s), [f"q_{i}" for i in range(5)]),
    "indel_rows": lambda s, d: rows.indel_rows(L.with_ref(V._indel_distance(s, d)), A.contigs(s), [f"q_{i}" for i in range(5)]),
    "distance_table": _distance_table,
    "scalar_helpers": _scalars,
    "simulated_calls": lambda s, d: simulate.draw_bases(L.loci(s), [(0.9, 0.1, 0, 0, 3.0), (0, 0, 0.5, 0.5, 1.0)], 20, 20).groupBy("tid", "base").agg(F.count("*").alias("n")),
}
ORACLES = {
    "virtual_bounds": f"WITH {A.POINTS_SQL} SELECT a.label, a.vec_id, a.p2 AS x, (SELECT count(*) FROM points b WHERE b.label = a.label AND b.p1 < a.p2) AS lower, (SELECT count(*) FROM points b WHERE b.label = a.label AND b.p1 <= a.p2) AS upper FROM points a",
    "depermute_points": f"WITH {A.POINTS_SQL} SELECT vec_id, p3 AS q1, p1 AS q2, p4 AS q3, p2 AS q4, p1, p2, p3, p4 FROM points",
    "ordered_cdf": f"WITH {A.POINTS_SQL} SELECT vec_id, round(sum(w) OVER (PARTITION BY label ORDER BY p1) / sum(w) OVER (PARTITION BY label), 6) AS cdf FROM points",
    "numerical_cdfs": f"WITH {A.POINTS_SQL}, l AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS dim, unnest([p1, p2, p3, p4]) AS value FROM points) SELECT vec_id, dim, value, CAST(row_number() OVER (PARTITION BY dim ORDER BY value, vec_id) - 1 AS INTEGER) AS rank FROM l",
    "pileup_rows": f"WITH RECURSIVE {L.FULL_SQL} SELECT sample, 'chr' || CAST(tid + 1 AS VARCHAR) AS contig, pos + 1 AS pos, ref_base, n_hi, calls, quals FROM full_pile",
    "sparse_depth_rows": f"WITH {A.DEPTH_SQL} SELECT sample, contig, pos, format('{{:6.4f}}', CAST(depth AS DOUBLE)) AS depth FROM depth WHERE depth <> 0",
    "scalar_helpers": "SELECT l_orderkey, l_linenumber, printf('%d:%02d:%02d', CAST(floor(l_extendedprice) AS BIGINT) // 3600, (CAST(floor(l_extendedprice) AS BIGINT) // 60) % 60, CAST(floor(l_extendedprice) AS BIGINT) % 60) AS elapsed, CAST(l_linenumber AS DOUBLE) AS number, CAST(l_suppkey AS VARCHAR) AS short, CAST(l_partkey % 5 AS INTEGER) AS nt4, 64 AS offset FROM lineitem",
}
