"""Reproducible shuffle into shards: a Feistel permutation with cycle walking.

Rows get global row numbers in the order of (doc_id, crc32, size), nulls first. A Feistel
network over two digits of mixed radix, a * b >= n, permutes 0 .. a*b - 1, and walking along
its cycle until the value is below n makes that a permutation of the n row numbers. The
permuted number p is in shard p % shards at slot p div shards, so that shard counts differ
by one at most, slots have no gaps, and shard and slot can be computed from the row number
and back. Equal rows are interchangeable. Null texts have no bytes: size 16, crc 0.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import numbered, table

PRIME, ROUNDS, SHARDS, SEED, EXTRA_BYTES, WALK = 2147483647, 6, 40, 20240501, 16, 64


def radices(n: int) -> tuple[int, int]:
    a = max(isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers a round from a linear congruence started at seed."""
    out, x = [], seed % PRIME
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            key.append(x + 1)
        out.append(tuple(key))
    return out


def _f(v, key):
    t = (v * key[0] + key[1]) % PRIME
    return (t * ((t // 32768) + key[2])) % PRIME


def permute(x: int, n: int, seed: int = SEED) -> int:
    """Where row number x of n goes."""
    a, b = radices(n)
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + _f(right, key)) % a
            else:
                right = (right + _f(left, key)) % b
        x = left * b + right
        if x < n:
            return x


def restore(p: int, n: int, seed: int = SEED) -> int:
    """The row number that permute sends to p."""
    a, b = radices(n)
    while True:
        left, right = divmod(p, b)
        for i, key in reversed(list(enumerate(round_keys(seed)))):
            if i % 2 == 0:
                left = (left - _f(right, key)) % a
            else:
                right = (right - _f(left, key)) % b
        p = left * b + right
        if p < n:
            return p


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """permute() as a column expression."""
    a, b = (F.lit(v).cast("long") for v in radices(n))
    keys = F.array(
        *[F.struct(F.lit(i % 2).alias("odd"), *[F.lit(k).cast("long").alias(f"k{j}") for j, k in enumerate(key)]) for i, key in enumerate(round_keys(seed))]
    )
    prime = F.lit(PRIME).cast("long")

    def f(v: Column, k: Column) -> Column:
        t = (v * k["k0"] + k["k1"]) % prime
        return (t * (F.shiftright(t, 15) + k["k2"])) % prime

    def one_round(v: Column, k: Column) -> Column:
        left, right = F.call_function("div", v, b), v % b
        return F.when(k["odd"] == 0, ((left + f(right, k)) % a) * b + right).otherwise(left * b + (right + f(left, k)) % b)

    def once(v: Column) -> Column:
        return F.aggregate(keys, v, one_round)

    ra, rb = radices(n)
    # A cycle leaves the range at most a*b - n times, and each further step has a chance under
    # 1 / sqrt(n); a walk that 64 steps do not end fails instead of giving a wrong place.
    steps = min(ra * rb - n, WALK)
    first = once(x.cast("long"))
    if steps == 0:
        return first
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    if steps == ra * rb - n:
        return last
    return F.when(last < n, last).otherwise(F.raise_error(F.lit("a cycle walk of the permutation did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard for every row of docs."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + EXTRA_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = numbered(slim, F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    n = rows.count()
    place = permuted(F.col("row_number"), n, seed) if n else F.col("row_number")
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle() -> str:
    keys = round_keys(SEED)
    once = (
        "list_reduce(list_prepend({x}, [1::BIGINT,2,3,4,5,6]), lambda v, k: CASE WHEN k % 2 = 1 "
        "THEN (((v // b) + f(v % b, k)) % a) * b + v % b ELSE (v // b) * b + ((v % b) + f(v // b, k)) % b END)"
    )
    lists = ["[" + ",".join(f"{k[j]}::BIGINT" for k in keys) + "]" for j in range(3)]

    def f(v: str) -> str:
        t = f"((({v}) * {lists[0]}[k] + {lists[1]}[k]) % {PRIME})"
        return f"(({t} * (({t} // 32768) + {lists[2]}[k])) % {PRIME})"

    once = once.replace("f(v % b, k)", f("v % b")).replace("f(v // b, k)", f("v // b"))
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(coalesce(text, '')))), "
        "lambda i: ('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), "
        f"lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    )
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + {EXTRA_BYTES} AS BIGINT) AS size, {crc} AS text_crc32 FROM d),
n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents),
m AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
r AS (SELECT c.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM c),
walk AS (
  SELECT row_number, {once.format(x="row_number")} AS v, n, a, b FROM r, m
  UNION ALL SELECT row_number, {once.format(x="v")}, n, a, b FROM walk WHERE v >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INTEGER) AS shard, v // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, r.row_number
FROM r JOIN walk ON r.row_number = walk.row_number AND walk.v < walk.n
"""


QUERIES = {"op5_sharding": query}
ORACLES = {"op5_sharding": oracle()}
