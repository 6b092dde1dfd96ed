"""The pigeonhole join of vectors: tiles, the threshold itself, repeated ids, and its SQL."""

import duckdb
import numpy as np
import pytest

from locuspark.llm import vectors
from tests.llm.test_llm import brute_links, closure


def found(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, cell int")
    return vectors.near_duplicates(df).collect()


def clustered(seed, groups, size, n):
    r = np.random.default_rng(seed)
    base = r.standard_normal((groups, n))
    return np.concatenate([base, *[base + s * r.standard_normal((groups, n)) for s in np.linspace(0.1, 0.4, size)]]).astype(np.float32)


@pytest.mark.parametrize("grid", [2, 4])
def test_cells_of_many_tiles(spark, monkeypatch, grid):
    monkeypatch.setattr(vectors, "TILE", 64)
    monkeypatch.setattr(vectors, "grid_coordinates", lambda classes: grid)
    monkeypatch.setattr(vectors, "AT_ONCE", 2048)
    x = clustered(4, 60, 9, 40)
    x = np.concatenate([x, np.tile(x[:1], (40, 1)), x[:1] + 0.05 * np.random.default_rng(1).standard_normal((200, 40)).astype(np.float32)])
    m = brute_links(x.astype(float))
    top = closure(range(len(x)), np.argwhere(np.tril(m, -1)).tolist())
    got = {y.vec_id: y for y in found(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])}
    assert m.sum() > 50_000
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (m[i].sum() - 1, top[i])


def test_cosines_about_the_threshold(spark):
    r, rows, want = np.random.default_rng(9), [], {}
    for k in range(300):
        u, w = r.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.95 + r.choice([-1, 1]) * 10.0 ** -r.integers(3, 13)
        v = c * u + np.sqrt(1 - c * c) * w
        rows += [(2 * k, u.tolist(), 1), (2 * k + 1, v.tolist(), 1)]
        want[2 * k] = int((u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= 0.95) if abs(c - 0.95) > 1e-11 else None
    got = {y.vec_id: y.n_links for y in found(spark, rows, "array<double>")}
    assert all(got[i] == n for i, n in want.items() if n is not None) and 0 < sum(got.values()) < 600


def test_budgets_keep_every_link():
    x = clustered(6, 200, 6, 64).astype(float)
    u = vectors.unit(x)
    q = np.rint(u @ vectors.rotation(64) * vectors.SCALE).astype(np.int16).astype(np.int64)
    a, b = np.nonzero(np.tril(u @ u.T >= 0.95, -1))
    gaps = [((q[a][:, s] - q[b][:, s]) ** 2).sum(axis=1) <= m for s, m in zip(vectors.blocks(64), vectors.budgets(64, 0.95))]
    assert len(a) > 100 and np.any(gaps, axis=0).all()


def test_repeated_ids_with_other_vectors(spark):
    a, b, c = np.eye(3, 20)
    rows = [(1, a.tolist(), 1), (7, a.tolist(), 1), (7, b.tolist(), 1), (9, b.tolist(), 1), (5, c.tolist(), 1), (None, c.tolist(), 1)]
    got = sorted(((y.vec_id or -1), y.n_links, y.component_id or -1, y.kept) for y in found(spark, rows))
    assert got == [(-1, 1, -1, True), (1, 1, 1, True), (5, 1, 5, True), (7, 1, 1, False), (7, 1, 1, False), (9, 1, 1, False)]


def test_lengths_out_of_range(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [-0.0, 1.0], 1), (4, [0.0, 1e308], 1)]
    got = {y.vec_id: (y.n_links, y.component_id) for y in found(spark, rows, "array<double>")}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_same_rows_as_the_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(vectors.ORACLES["op1_embedding_neardup"]).fetchall())
    assert sorted(map(tuple, vectors.query(spark, sf).collect())) == want
