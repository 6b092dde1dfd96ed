"""Each operator against brute force, exact round trips or held-out accuracy, and edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locuspark.llm import common, langid, minhash, mixing, pieces, secret_scan, sharding, shingles, token_counts, tokenbin, topk, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, _mark string, copies_ int"
WORDS = [f"w{i}" for i in range(400)]


def edge_docs():
    r = np.random.default_rng(3)
    base = " ".join(r.choice(WORDS, 120))
    near = base.split()
    near[60] = "changed"
    texts = [base, " ".join(near), base.upper(), "", None, "one two", "One  two", "same same same same same same", "x" * 30000, "a b c d e\n\nf\tg", " ".join(r.choice(WORDS, 90)), " ▁ 👍 é "]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "m", "n", 1) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, 1, None, None, None), (0, base, "en", None, 5, "m", "n", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_docs(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets(text, words=5):
    parts = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not parts:
        return set()
    return {tuple(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))}


def closure(ids, linked):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def test_shingles_match_plain_sets():
    for _, t, *_ in edge_docs():
        assert len(shingles.shingle_hashes(t)) == len(sets(t))


def test_near_duplicates_against_brute_force(spark, docs):
    r = np.random.default_rng(5)
    rows = [x for x in edge_docs() if x[0] is not None]
    for g in range(6):
        base = list(r.choice(WORDS, 80))
        for k in range(12):
            t = list(base)
            for _ in range(r.integers(0, 6)):
                t[r.integers(0, 80)] = "z"
            rows.append((100 + 20 * g + k, " ".join(t), "en", "s", 1, "m", "n", 1))
    got = {(x.doc_id, x.n_shingles): x for x in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    by_id = [(x[0], sets(x[1])) for x in rows]
    linked = [(a, b) for i, (a, s) in enumerate(by_id) for b, t in by_id[:i] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    top = closure({i for i, _ in by_id}, linked)
    for i, s in by_id:
        assert got[i, len(s)].component_id == top[i] and got[i, len(s)].kept == (top[i] == i)


def test_short_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(11)
    rows = []
    for g in range(150):
        base = [f"g{g}w{k}" for k in range(r.integers(7, 13))]
        copy = base[:-1] if g % 3 == 0 else base[1:] if g % 3 == 1 else [*base, f"g{g}x"]
        rows += [(2 * g, " ".join(base), "en", "s", 1, "m", "n", 1), (2 * g + 1, " ".join(copy), "en", "s", 1, "m", "n", 1)]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    by_id = [(x[0], sets(x[1])) for x in rows]
    linked = [(a, b) for i, (a, s) in enumerate(by_id) for b, t in by_id[:i] if 100 * len(s & t) >= 75 * len(s | t)]
    assert len(linked) > 100 and got == closure([i for i, _ in by_id], linked)


def test_near_duplicates_keep_null_ids_and_empty_tables(spark, docs, empty):
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == docs.count() and [x.kept for x in out if x.doc_id is None] == [True]
    assert minhash.near_duplicates(empty).count() == 0


def test_union_sketch_is_exact_for_short_sets():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 60, 40).astype(np.uint32)) for _ in range(2))
        m = np.full((2, minhash.WIDE), minhash.EMPTY, np.uint32)
        m[0, : len(a)], m[1, : len(b)] = a, b
        common, union = minhash.overlap(m[:1], m[1:])
        assert (common[0], union[0]) == (len(np.intersect1d(a, b)), len(np.union1d(a, b)))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (40, 40)] + [(100 + i, 101 + i) for i in range(60)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({i for e in edges for i in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 40}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 97, 1000])
def test_permutation(spark, n):
    p = [sharding.permute(i, n) for i in range(n)]
    assert sorted(p) == list(range(n)) and [sharding.restore(x, n) for x in p] == list(range(n))
    if n in (5, 97):
        got = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
        assert all(p[x.id] == x.p for x in got)


def test_shards(docs, empty):
    out = sharding.shard(docs).collect()
    for x in out:
        place = sharding.permute(x.row_number, len(out))
        assert (x.shard, x.slot) == (place % 40, place // 40)
    sizes = {(x.doc_id, x.size, x.text_crc32) for x in out}
    assert all((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) in sizes for d, t, *_ in edge_docs())
    assert sharding.shard(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5 if i % 2 else 0}", 1, "m", "n", 1) for i in range(2000)]
    out = mixing.mix_counts(spark.createDataFrame(rows, DOCS)).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 15
    assert (out.taken <= 3 * out["size"]).all() and np.isclose(out.groupby("source").target.first().sum(), out["size"].sum())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0


def brute_links(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T >= threshold


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 20))
    x = np.concatenate([base, base[:15] + 0.12 * r.standard_normal((15, 20)), base[:15] + 0.2 * r.standard_normal((15, 20)), np.tile(base[:1], (5, 1)), 3 * base[:2]])
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, [None] * 20, 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, digest int")
    got = {x_.vec_id: x_ for x_ in vectors.near_duplicates(df).collect()}
    m = brute_links(np.concatenate([x, x[:1]]))
    top = closure(range(len(x)), [(a, b) for a in range(len(x)) for b in range(a) if m[a, b]])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (m[i].sum() - 1, top[i], top[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203, 204))
    assert (got[206].component_id, got[205].n_links) == (205, 1)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_top_products_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 8)) * np.exp(r.standard_normal((600, 1)))
    x[:60] += 6 * x[0]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None, 1), (920, [float("inf")] * 8, 1), (940, [1.0], 1), (960, [], 1)], "vec_id long, embedding array<double>, place int")
    old = topk.BUCKET, topk.RUN
    topk.BUCKET, topk.RUN = 64, 2
    try:
        got = {}
        for y in topk.top_products(df).collect():
            got.setdefault(y.query_id, []).append((y.rank, y.vec_id, y.score))
        q = np.floor(64 * x)
        for i in range(0, 600, 20):
            s = (q @ q[i]).astype(int)
            order = [j for j in np.lexsort((np.arange(600), -s)) if j != i][:20]
            assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(order)]
        assert set(got) == set(range(0, 600, 20))
        assert topk.top_products(df.limit(0)).count() == 0
    finally:
        topk.BUCKET, topk.RUN = old


def test_coordinate_pruning_keeps_all():
    r = np.random.default_rng(6)
    p = r.standard_normal((300, 4))
    b = topk._Block(np.arange(20), np.arange(20) + 1000, np.round(r.standard_normal((20, 4)) * 50), np.full(20, -np.inf), 5)
    whole = [np.round(p[i::3] * 40 / (i + 1)) for i in range(3)]
    for k, part in enumerate(whole):
        b.meet(np.arange(100) * 3 + k, part)
    every = np.concatenate(whole)
    ids = np.concatenate([np.arange(100) * 3 + k for k in range(3)])
    for i in range(20):
        s = (every @ b.v[i]).astype(int)
        order = np.lexsort((ids, -s))[:5]
        assert list(b.best[i][0]) == list(ids[order]) and list(b.best[i][1]) == list(s[order])


def test_pieces_round_trip(docs, empty):
    path = pieces.model_path()
    encoded = common.stash(pieces.sample_pieces(docs, path))
    back = sorted((x.doc_id or -1, x.text or "", x.text is None) for x in pieces.decode_pieces(encoded, path).collect())
    assert back == sorted((d or -1, t or "", t is None) for d, t, *_ in edge_docs())
    assert pieces.sample_pieces(empty, path).count() == 0
    again = pieces.sample_pieces(docs.repartition(3), path)
    assert encoded.exceptAll(again).isEmpty()


def test_pieces_follow_the_lattice():
    own = pieces.Lattices(pieces.model_path())
    word = " there"
    ids, cuts = own.sample([word] * 20000, np.arange(20000), 3)
    seen = {}
    for s, e in zip(cuts[:-1], cuts[1:]):
        key = tuple(ids[s:e].tolist())
        seen[key] = seen.get(key, 0) + 1
    names = {own.bytes_of[i].decode(): i for i in range(259, len(own.bytes_of)) if own.bytes_of[i]}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in names:
                for tail, cost in paths(rest[k:]):
                    yield (names[rest[:k]], *tail), cost + own.cost[names[rest[:k]]]

    shares = {p: np.exp(c) for p, c in paths(word)}
    total = sum(shares.values())
    assert set(seen) <= set(shares)
    assert max(abs(seen.get(p, 0) / 20000 - v / total) for p, v in shares.items()) < 0.02


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenbin.TOKENIZER)
    plain = Tokenizer.from_file(path)
    for df, rows in ((docs, edge_docs()), (empty, [])):
        uri = common.fresh_path(spark, "tokens")
        got = tokenbin.read_tokens(tokenbin.write_tokens(df, uri, path), uri).collect()
        want = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
        assert sorted((x.doc_id or -1, x.n_tokens, x.ids_crc32) for x in got) == sorted((d or -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
        start = 0
        for x in sorted(got, key=lambda x: x.start):
            assert x.start == start
            start += x.n_tokens
        order = [x.doc_id if x.doc_id is not None else -1 for x in sorted(got, key=lambda x: x.start)]
        assert order == sorted(order)


def test_counts_follow_edits(docs, empty):
    own = token_counts.Counter(public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN)
    r = np.random.default_rng(8)
    bits = ["a", "b ", "  ", "\n", "'s", "'re", "'", "é", "9", "!!", "   ", "👍"]
    for _, text, *_ in edge_docs():
        now = text or ""
        cut = own.cut(now)
        tree = token_counts.SegmentTree(cut, own.counts(cut))
        for _ in range(20):
            s, d, new = int(r.integers(0, len(now) + 1)), int(r.choice([0, 1, 3, 20])), "".join(r.choice(bits, r.integers(0, 5)))
            tree.edit(own, s, d, new)
            now = now[:s] + new + now[s + d :]
            assert tree.tokens[1] == len(own.coder.encode_ordinary(now))
    path = public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN
    out = token_counts.count_edited(docs.withColumn("edits", token_counts.planned_edits()), *path)
    want = sorted(len(own.coder.encode_ordinary(t or "")) for _, t, *_ in edge_docs())
    assert sorted(x.n_tokens for x in out.collect()) == want
    assert token_counts.count_edited(empty.withColumn("edits", token_counts.planned_edits()), *path).count() == 0
    trees = token_counts.build_trees(docs, *path).collect()
    assert sorted(x.tokens[0] for x in trees) == want


def test_languages(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(labelled.where("doc_id % 2 = 0"))
    held = labelled.where("doc_id % 2 = 1")
    found = langid.identify_documents(held.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")), model)
    wrong = found.join(held, F.col("id") == F.col("doc_id")).where(found["lang"] != held["lang"]).count()
    assert wrong <= 0.03 * held.count()
    assert langid.accepted(held).count() >= 0.99 * held.count()
    assert langid.accepted(docs).columns == docs.columns and langid.accepted(empty).count() == 0
    pages = spark.createDataFrame([(1, "http://a.example.fr/x", '<html lang="fr"><p>le la les des une</p>'), (2, None, None), (3, "bad", "")], "page_id long, url string, html string")
    got = {x.id: x for x in langid.identify_pages(pages, model).collect()}
    assert got[1].declared == "fr" and not got[2].accepted and not got[3].accepted


def test_redaction(spark, docs, empty):
    key = "a3f1c29b7de04856b1aa90c34de77f0192ab34cd"
    rows = [(1, f'x token = "{key}" y {key}', "en", "s", 0, "m", "n", 1), (2, "plain words only", "en", "s", 16, "m", "n", 1), (3, None, None, None, None, None, None, None)]
    got = {x.doc_id: x for x in secret_scan.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert key not in got[1].text and got[1].n_chars == len(got[1].text) and got[2].text == rows[1][1] and got[3].text is None
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(empty).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, empty):
    for df in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            out.count()
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [0, 3, 4, 5, 7, 8, 9, 10, 11]
