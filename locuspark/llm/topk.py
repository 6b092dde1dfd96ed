"""Exact top-k inner products by norm-bucketed retrieval.

A range sort by length deals all vectors into buckets of like lengths. A first pass scores the
query set against the longest bucket alone, which gives each query a threshold: its k-th
score there. In the second pass each bucket turns that into a local threshold for the cosine,
threshold / (|q| * longest of the bucket). Above 1 the query skips the bucket; if it is high,
the bucket prunes by coordinates: the query's largest coordinate bounds what the same
coordinate of a unit vector of that cosine may be; else it prunes by length: vectors shorter
than threshold / |q| go. What is left is multiplied out in integers, and thresholds rise from
bucket to bucket. Ties at a threshold stay, so ties to the smaller id are exact. Runs of buckets
whose longest vector cannot reach any threshold of a block of queries are not shuffled to it.

Components x count as floor(64 * x). Vectors that are null or hold null or non-finite
components take no part; vectors of another dimension than the query's are no candidates; an
empty or zero vector scores 0. Scores beyond 2 ** 53 are computed in Python integers and end
at the bounds of a long. Rows with a null id take no part. A repeated query id is asked once for each of its rows; a query's own
id is no candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locuspark.llm.common import if_bounded, numbered, stash, table
from locuspark.llm.vectors import usable

TOP, EVERY, SCALE, BUCKET, RUN, BLOCK, HIGH = 20, 20, 64, 4096, 8, 2048, 0.6
LARGEST, SMALLEST = 2**63 - 1, -(2**63)


def _products(q: np.ndarray, p: np.ndarray, largest: float) -> np.ndarray:
    if largest < 2**53:
        return (q @ p.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in p], object).T
    return np.clip(exact, SMALLEST, LARGEST).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, top: int):
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


class _Block:
    """A block of queries and the best candidates so far."""

    def __init__(self, uid, ids, v, threshold, top):
        self.uid, self.ids, self.v, self.top = uid, ids, v, top
        self.length = np.sqrt((v * v).sum(axis=1))
        self.floor = threshold.astype(np.float64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def meet(self, ids: np.ndarray, p: np.ndarray) -> None:
        """One bucket: a matrix of vectors of like lengths."""
        length = np.sqrt((p * p).sum(axis=1))
        longest = length.max(initial=0.0)
        known = np.isfinite(self.floor)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(known, self.floor / (self.length * longest), -np.inf)
        local = np.where(np.isnan(local), -np.inf, local)
        todo = np.flatnonzero(local <= 1 + 1e-9)
        if not len(todo):
            return
        unit = p / np.maximum(length, 1e-300)[:, None]
        by_coordinate = local[todo] >= HIGH
        for i in todo[by_coordinate]:
            q = self.v[i] / self.length[i]
            f = int(np.argmax(np.abs(q)))
            mid, room = q[f] * local[i], np.sqrt(max(1 - q[f] ** 2, 0) * max(1 - local[i] ** 2, 0)) + 1e-9
            # A unit vector with a cosine of c >= local has this coordinate in
            # [q c - room(c), q c + room(c)]; over all c up to 1 that is the hull below.
            low = -1.0 if q[f] <= -local[i] else min(mid - room, q[f])
            high = 1.0 if q[f] >= local[i] else max(mid + room, q[f])
            low = -1.0 if -q[f] >= local[i] else low
            at = np.flatnonzero((unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9) & (length * self.length[i] >= self.floor[i] * (1 - 1e-9)))
            self._score(np.array([i]), ids[at], p[at])
        rest = todo[~by_coordinate]
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(known[rest] & (self.floor[rest] > 0), self.floor[rest] / self.length[rest], 0.0).min()
            at = np.flatnonzero(length >= need * (1 - 1e-9))
            self._score(rest, ids[at], p[at])

    def _score(self, rows: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        if not len(ids):
            return
        largest = float(np.abs(self.v[rows]).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(p.shape[1], 1)
        scores = _products(self.v[rows], p, largest)
        for i, row in zip(rows, scores):
            ok = np.flatnonzero((row >= self.floor[i]) & (ids != self.ids[i]))
            if not len(ok):
                continue
            if len(ok) > self.top:
                kth = np.partition(row[ok], len(ok) - self.top)[len(ok) - self.top]
                ok = ok[row[ok] >= kth]
            a, s = self.best[i]
            self.best[i] = _best(np.r_[a, ids[ok]], np.r_[s, row[ok]], self.top)
            if len(self.best[i][1]) == self.top:
                self.floor[i] = max(self.floor[i], float(np.nextafter(float(self.best[i][1][-1]), -np.inf)) if abs(self.best[i][1][-1]) >= 2**53 else self.best[i][1][-1])

    def rows(self):
        n = [len(a) for a, _ in self.best]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(self.uid, n)), pa.array(np.repeat(self.ids, n)),
                    pa.array(np.concatenate([a for a, _ in self.best])), pa.array(np.concatenate([s for _, s in self.best])),
                ],
                names=["uid", "query_id", "vec_id", "score"],
            )


def _matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, n) if n else np.zeros((len(column), 0))


def _search(top: int):
    """Rows sorted by (dim, qblock, run, is candidate, bucket): queries first, then buckets in turn."""

    def run(batches):
        name, block, queries, bucket, bucket_no = None, None, [], [], None

        def close_queries():
            nonlocal block, queries
            if queries:
                x = pa.Table.from_batches(queries).combine_chunks()
                block = _Block(x["uid"].to_numpy(), x["vec_id"].to_numpy(), _matrix(x["v"], name[0]), x["floor"].to_numpy(), top)
                queries = []

        def close_bucket():
            nonlocal bucket
            if bucket and block is not None:
                x = pa.Table.from_batches(bucket).combine_chunks()
                block.meet(x["vec_id"].to_numpy(), _matrix(x["v"], name[0]))
            bucket = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "qblock", "run", "kind", "bucket")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                now, kind, b = tuple(keys[start][:3]), keys[start][3], keys[start][4]
                if now != name:
                    close_queries()
                    close_bucket()
                    if block is not None:
                        yield from block.rows()
                    name, block, bucket_no = now, None, None
                part = batch.slice(start, end - start)
                if kind == 0:
                    queries.append(part)
                    continue
                close_queries()
                if b != bucket_no:
                    close_bucket()
                    bucket_no = b
                bucket.append(part)
        close_queries()
        close_bucket()
        if block is not None:
            yield from block.rows()

    return run


def _pass(queries: DataFrame, candidates: DataFrame, met: DataFrame, top: int) -> DataFrame:
    """uid, query_id, vec_id, score: each query's best of each run of buckets.

    met: n, qblock, run, the pairs of a block of queries and a run that can add to a result;
    only they are shuffled.
    """
    met = if_bounded(met, "run")
    asked = queries.join(met, ["n", "qblock"]).select("n", "qblock", "run", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), "uid", "vec_id", "floor", "v")
    given = candidates.join(met, ["n", "run"]).select(
        "n", "qblock", "run", F.lit(1).alias("kind"), "bucket", F.lit(0).cast("long").alias("uid"), "vec_id", F.lit(0.0).alias("floor"), "v"
    )
    dealt = asked.union(given).repartition("n", "qblock", "run").sortWithinPartitions("n", "qblock", "run", "kind", "bucket", "uid")
    return dealt.mapInArrow(_search(top), "uid long, query_id long, vec_id long, score long")


def _met(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks of queries and runs of buckets whose longest vector can reach a threshold of the block.

    A row a block, joined to a row a run; both are counts of thousands of vectors.
    """
    need = F.when(F.col("floor") <= 0, F.lit(float("-inf"))).when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(float("inf")))
    blocks = queries.groupBy("n", "qblock").agg(F.min(need).alias("need"))
    runs = candidates.groupBy("n", "run").agg(F.max("length").alias("longest"))
    return stash(blocks.join(runs, "n").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("n", "qblock", "run"), "met")


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score for the rows whose vec_id is divisible by `every`."""
    rows = vectors.where(usable() | (F.size("embedding") == 0)).where("vec_id is not null")
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE).alias("x"))

    def pack(batches):
        for batch in batches:
            x = batch.column("x")
            lengths = np.asarray(x.value_lengths())
            flat = np.floor(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            cuts = np.r_[0, np.cumsum(lengths)]
            parts = [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(lengths, pa.int32()), pa.array([float(np.sqrt((p * p).sum())) for p in parts]), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["vec_id", "n", "length", "v"],
            )

    packed = slim.mapInArrow(pack, "vec_id long, n int, length double, v binary")
    ranked = numbered(packed, F.col("n"), F.col("length").desc(), F.col("vec_id"), F.col("v"), name="place")
    firsts = stash(ranked.groupBy("n").agg(F.min("place").alias("first")), "firsts")
    bucket = F.call_function("div", F.col("place") - F.col("first"), F.lit(BUCKET))
    held = stash(
        ranked.join(firsts, "n").select("n", "vec_id", "v", "length", F.col("place").alias("uid"), bucket.alias("bucket"), F.call_function("div", bucket, F.lit(RUN)).alias("run")),
        "buckets",
    )
    asked = numbered(held.where(F.pmod("vec_id", F.lit(every)) == 0).select("n", "vec_id", "v", "length", "uid"), F.col("n"), F.col("uid"), name="q")
    starts = asked.groupBy("n").agg(F.min("q").alias("q0"))
    firsts = stash(starts.select("n", "q0"), "blocks")
    queries = asked.join(firsts, "n").select("n", F.call_function("div", F.col("q") - F.col("q0"), F.lit(BLOCK)).alias("qblock"), "uid", "vec_id", "v", "length")
    unbounded, head, rest = queries.withColumn("floor", F.lit(float("-inf"))), held.where("bucket = 0"), held.where("bucket > 0")
    longest = stash(_pass(unbounded, head, _met(unbounded, head), top), "longest")
    floors = longest.groupBy("uid").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= top).select("uid", F.col("s").cast("double").alias("floor"))
    bounded = queries.join(floors, "uid", "left").select("n", "qblock", "uid", "vec_id", "length", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v")
    others = _pass(bounded, rest, _met(bounded, rest), top)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return longest.union(others).withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_topk": query}
ORACLES = {
    "op3_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
}
