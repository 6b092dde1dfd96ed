"""Near-duplicate documents by bottom-k sketches.

One hash function; a sketch keeps the K smallest shingle hashes of a text. Every run of RUN
neighbouring retained values is a key of an inverted list, and in sets of at most SHORT values
so is every single value. Documents with a Jaccard similarity of 0.75 share, value by value,
three quarters of the bottom of their union, and values next to each other there that both
hold are next to each other in both sketches. Unions of up to 8 values may have no such run;
both sets are short then and meet in the list of any value they share. Unions of 9 to K values
always have one, as what u / 4 values part into runs below RUN is at most u / 2 + 2. In larger
unions the chance of none at the bottom is below 0.75 ** 62, about 2e-8. The union
sketch then estimates the similarity, first from K values, then from WIDE: pairs under 0.4 or
0.55 go (a pair at 0.75 goes with a chance below 5e-8). Where both sketches hold their whole
sets, what they say is exact and only pairs near 0.75 or above stay. Those are compared on
their full sets.

Lists may be long, so pairs within a list are not spelled out. First each member meets only
the smallest document of its list. What these links leave in different components meets in a
second step, block by block inside numpy. Documents whose sets are equal are one class
throughout. Nothing is capped or sampled.

Null ids: such rows come back with a null component, kept. Empty or null texts: no shingles,
linked with nothing. Repeated ids: one node, linked by any of its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import components, if_bounded, slices, stash, table
from locuspark.llm.shingles import set_digest, shingle_hashes

#: Retained values that make lists, and values of a whole sketch; values in a run; the largest
#: sets whose single values make lists too; how far an
#: estimate from either may fall short of the similarity asked for; the elements that hash
#: collisions may cost a complete sketch.
K, WIDE, RUN, SHORT, GAP, WIDE_GAP, SLACK, TILE = 64, 192, 3, 10, 0.35, 0.2, 2, 2048
EMPTY = np.uint32(0xFFFFFFFF)


def _sketches(words: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, digests, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, words)
                sizes.append(len(h))
                digests.append(set_digest(h))
                sketches.append((h[:WIDE] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return run


def _matrix(column) -> np.ndarray:
    out = np.full((len(column), WIDE), EMPTY, np.uint32)
    for row, raw in zip(out, column.to_pylist()):
        row[: len(raw) // 4] = np.frombuffer(raw, "<u4")
    return out


def run_keys(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of neighbouring values in each sketch, and which of them are real.

    A sketch shorter than a run is one key. The single values of short sets take the last
    columns, where such sets have no runs.
    """
    s = sketches[:, :K].astype(np.uint64)
    runs = s[:, : K - RUN + 1].copy()
    for j in range(1, RUN):
        runs = (runs * np.uint64(0x9E3779B97F4A7C15)) ^ (runs >> np.uint64(29)) ^ s[:, j : K - RUN + 1 + j]
    whole = s[:, RUN - 1 : K] != np.uint64(EMPTY)
    whole[:, 0] = True
    short = np.flatnonzero(s[:, SHORT] == np.uint64(EMPTY))
    runs[short, -SHORT:] = (s[short, :SHORT] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    whole[short, -SHORT:] = s[short, :SHORT] != np.uint64(EMPTY)
    return runs.view(np.int64), whole


def _keys(batches):
    """(key, id, size) for each run of neighbouring retained values, and each value of short sets."""
    for batch in batches:
        runs, whole = run_keys(_matrix(batch.column("sketch")))
        row, _ = np.nonzero(whole)
        ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False))
        sizes = np.asarray(batch.column("n").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(runs[whole]), pa.array(ids[row]), pa.array(sizes[row])], names=["key", "id", "n"]
        )


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common and all values among the smallest of each pair's union, as many as a sketch has."""
    k = a.shape[1]
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != EMPTY
    inside = real & ((np.cumsum(~same & real, axis=1) <= k) | ((a[:, -1:] == EMPTY) & (b[:, -1:] == EMPTY)))
    return (same & inside).sum(axis=1), (~same & inside).sum(axis=1)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may belong to sets as similar as `percent`."""
    common, union = overlap(a[:, :K], b[:, :K])
    keep = common >= (percent / 100 - GAP) * union
    at = np.flatnonzero(keep)
    x, y = a[at], b[at]
    common, union = overlap(x, y)
    whole = (x[:, -1] == EMPTY) & (y[:, -1] == EMPTY)
    keep[at] = np.where(whole, 100 * (common + SLACK) >= percent * (union - SLACK), common >= (percent / 100 - WIDE_GAP) * union)
    return keep


def _estimate(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = alike(_matrix(part.column("sa")), _matrix(part.column("sb")), percent)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _cross(batches, percent: int):
    """Pairs of a list's tile in different components whose sketches overlap enough.

    Rows come sorted by list and tile; one tile pair, of at most about 2 * TILE rows, is held.
    A pair that shares several lists is looked at in the one with the smallest key alone.
    """
    held, name = [], None

    def pairs(parts):
        x = pa.Table.from_batches(parts)
        ids, comp, n, side = (x.column(c).to_numpy() for c in ("id", "component", "n", "side"))
        s, key = None, x.column("key")[0].as_py()
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids)) if side[i] == 2 else np.flatnonzero(side == 1) if side[i] == 0 else ()
            if not len(j):
                continue
            j = j[(comp[j] != comp[i]) & (ids[j] != ids[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if len(j):
                if s is None:
                    s = _matrix(x.column("sketch").combine_chunks())
                    runs, whole = run_keys(s)
                    # Only keys below the list's own could be a smaller one that a pair shares.
                    lower = whole & (runs < key)
                mine = runs[i][lower[i]]
                for k in range(0, len(j), 1024):
                    part = j[k : k + 1024]
                    if len(mine):
                        part = part[~((runs[part][:, :, None] == mine[None, None, :]) & lower[part][:, :, None]).any(axis=(1, 2))]
                    part = part[alike(np.repeat(s[i : i + 1], len(part), axis=0), s[part], percent)]
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(ids[i], ids[part])), pa.array(np.maximum(ids[i], ids[part]))], names=["a", "b"]
                        )

    for batch in batches:
        key, ti, tj = (batch.column(c).to_numpy() for c in ("key", "ti", "tj"))
        if not len(key):
            continue
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
            now = (key[start], ti[start], tj[start])
            if now != name and held:
                yield from pairs(held)
                held = []
            name = now
            held.append(batch.slice(start, end - start))
    if held:
        yield from pairs(held)


def _full_sets(words: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            raw = [shingle_hashes(text, words).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["id", "hashes"])

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(if_bounded(ids, "id", 1_000_000, 8 << 20), docs["doc_id"] == ids["id"], "left_semi")
    sets = stash(texts.mapInArrow(_full_sets(words), "id long, hashes binary"), "sets")
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b"
    )
    return stash(wide.select("a", "b", "ha", "hb").mapInArrow(_exact(percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stash(docs.mapInArrow(_sketches(words), "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
    named = base.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stash(named.groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    members = stash(named.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class"), "members")
    mine = (named["digest"] == classes["digest"]) & (named["doc_id"] == classes["class"])
    reps = named.join(classes, mine, "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    reps = stash(reps.distinct(), "reps")

    rows = reps.mapInArrow(_keys, "key long, id long, n long")
    lists = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("first")).where("m > 1")
    listed = stash(rows.join(lists, "key").select("key", "id", "n", "m", F.col("first.id").alias("a"), F.col("first.n").alias("na")), "lists")
    sizes_fit = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    stars = listed.where((F.col("id") != F.col("a")) & sizes_fit).select("a", F.col("id").alias("b")).distinct()
    sketches = reps.select("id", "sketch")
    stars = stars.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    stars = stash(stars.select("a", "b", "sa", "sb").mapInArrow(_estimate(percent), "a long, b long").distinct(), "stars")
    links = _verified(docs, stars, words, percent)

    parts = stash(components(links), "parts")
    placed = listed.select("key", "id", "n").join(parts, F.col("id") == F.col("node"), "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")
    )
    placed = stash(placed, "placed")
    mixed = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    open_rows = (
        placed.join(mixed.select("key", tiles.alias("nt")), "key")
        .join(sketches, "id")
        .withColumn("t", F.pmod(F.xxhash64("id"), F.col("nt")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
        .select(
            "key", F.least("t", "j").alias("ti"), F.greatest("t", "j").alias("tj"),
            F.when(F.col("t") == F.col("j"), 2).when(F.col("t") < F.col("j"), 0).otherwise(1).alias("side"),
            "id", "component", "n", "sketch",
        )
    )
    dealt = open_rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "id")
    across = dealt.mapInArrow(lambda batches: _cross(batches, percent), "a long, b long").distinct()
    across = stash(across.join(stars, ["a", "b"], "left_anti"), "across")
    more = _verified(docs, across, words, percent)

    edges = links.union(more).union(members.where(F.col("doc_id") != F.col("class")).select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
    final = stash(components(edges), "components")
    return (
        base.join(final, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash": query}
ORACLES = {
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.a = s.doc_id
"""
}
