"""Queries against their SQL, and edge cases of sharding, mixing, search and list keys."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.llm import minhash, mixing, registry, sharding, topk

SMALL = "/root/testdata/sf0.001"
ORDER = {"op5_sharding": "doc_id, size, text_crc32, law, shard, slot, grown_shard", "op8_mixing": "doc_id, size, source_size, target, taken", "op7_minhash": "doc_id, n_shingles, component_id, kept", "op3_topk": "query_id, rank, vec_id, score"}


@pytest.mark.parametrize("name", sorted(ORDER))
def test_same_rows_as_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = con.execute(f"SELECT {ORDER[name]} FROM ({registry.oracle_sql()[name]}) AS q").fetchall()
    ours = registry.queries()[name](spark, SMALL)
    assert ours.columns[: len(ORDER[name].split(","))] == ORDER[name].split(", ")
    key = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert sorted(map(repr, map(key, ours.select(*ORDER[name].split(", ")).collect()))) == sorted(map(repr, map(key, theirs)))


def test_similar_sets_of_every_size_meet_in_a_list():
    r = np.random.default_rng(17)
    for n in range(1, 81):
        for _ in range(60):
            common = int(np.ceil(0.75 * n)) + int(r.integers(0, 3))
            union = min(n, common) if common > n else n
            common = min(common, union)
            left = int(r.integers(0, union - common + 1))
            values = np.unique(r.integers(1, 1 << 31, union * 2, dtype=np.uint32))
            r.shuffle(values)
            values = values[:union]
            a, b = np.sort(values[: common + left]), np.sort(np.r_[values[:common], values[common + left :]])
            if 100 * common < 75 * len(np.union1d(a, b)):
                continue
            m = np.full((2, minhash.WIDE), minhash.EMPTY, np.uint32)
            m[0, : len(a)], m[1, : len(b)] = a, b
            keys, real = minhash.run_keys(m)
            assert set(keys[0][real[0]]) & set(keys[1][real[1]]), (n, common, len(a), len(b))


def test_large_similar_sets_meet_and_are_estimated():
    r = np.random.default_rng(18)
    for n in (100, 400, 3000):
        for _ in range(30):
            values = r.choice(np.uint32(0xFFFFFFFE), n, replace=False).astype(np.uint32)
            common = int(np.ceil(0.76 * n))
            a, b = np.sort(np.r_[values[:common], values[common::2]])[: minhash.WIDE], np.sort(np.r_[values[:common], values[common + 1 :: 2]])[: minhash.WIDE]
            m = np.full((2, minhash.WIDE), minhash.EMPTY, np.uint32)
            m[0, : len(a)], m[1, : len(b)] = a, b
            keys, real = minhash.run_keys(m)
            assert set(keys[0][real[0]]) & set(keys[1][real[1]]) and minhash.alike(m[:1], m[1:], 75)[0]


def test_lists_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    r = np.random.default_rng(19)
    rows = []
    for g in range(3):
        head = [f"c{i}" for i in range(30)]
        tail = [f"g{g}x{i}" for i in range(60)]
        for k in range(40):
            t = list(tail)
            t[int(r.integers(0, 60))] = f"z{k}"
            rows.append((1000 * g + k, " ".join(head + t)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 1000 for d, _ in rows}


def filled(sizes, weights, most=3):
    total, targets, free = sum(sizes), {}, list(range(len(sizes)))
    rest = float(total)
    while free:
        share = rest / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > most * sizes[i]]
        if not over:
            targets |= {i: weights[i] * share for i in free}
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            rest -= targets[i]
        free = [i for i in free if i not in over]
    return [targets[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_against_brute_force_water_filling(spark, seed):
    r = np.random.default_rng(seed)
    names = [*sorted(f"{'ABab'[i % 4]}é{i}" for i in range(8)), None]
    rows = [(i, names[k], "w " * int(n)) for i, (k, n) in enumerate(zip(r.choice(9, 700, p=[0.5, 0.2, 0.1, 0.1, 0.04, 0.03, 0.01, 0.01, 0.01]), r.integers(0, 30, 700)))]
    rows += [(None, None, None), (None, names[0], "x y"), (5, names[0], "x y"), (5, names[0], "x y")]
    out = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    sizes = [sum(len((t or "").split()) for _, s, t in rows if s == n) for n in names]
    want = dict(zip(names, filled(sizes, [i % 3 + 1 for i in range(9)])))
    taken = {n: 0 for n in names}
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.copies <= 3 and x.taken == x.copies * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[n] - want[n]) <= 45 for n in names) and len(out) == len(rows)


def test_a_walk_that_does_not_end_fails(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WALK", 1)

    def steps(x, n):
        a, b = sharding.radices(n)
        k = 0
        while True:
            left, right = divmod(x, b)
            for i, key in enumerate(sharding.round_keys(sharding.SEED)):
                if i % 2 == 0:
                    left = (left + sharding._f(right, key)) % a
                else:
                    right = (right + sharding._f(left, key)) % b
            x, k = left * b + right, k + 1
            if x < n:
                return k

    for n in range(3, 400):
        a, b = sharding.radices(n)
        if a * b - n > 1 and max(steps(x, n) for x in range(n)) > 2:
            break
    with pytest.raises(Exception, match="did not end"):
        spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()


def test_ties_repeated_ids_and_large_scores(spark):
    v = [1.0, 0.0, 2.0**24, -1.0]
    rows = [(20, v)] + [(i, v) for i in range(21, 60) if i != 40] + [(40, [0.5, 0.5, 0.5, 0.5]), (40, v), (61, [2.0**26] * 4)]
    got = {}
    for x in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    whole = {i: [int(np.floor(64 * c)) for c in e] for i, e in rows if i != 40}
    first = sorted(got[20])
    scores = sorted(((sum(a * b for a, b in zip(whole[20], e)), -i) for i, e in whole.items() if i != 20), reverse=True)
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
    assert first[0][1] == 61 and first[0][2] == clip(scores[0][0])
    assert [i for _, i, _ in first[1:]] == list(range(21, 40))
    assert len(got[40]) == 40
