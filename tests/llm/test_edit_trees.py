"""Trees that are kept in a table and edited there count as the whole edited texts do."""

import numpy as np
import public_tokenizers

from locuspark.llm import common, token_counts
from tests.llm.test_llm import edge_docs

PATH = public_tokenizers.path(token_counts.RANKS), public_tokenizers.PATTERN
BITS = ["a", "b ", "  ", "\n", "'s", "'re", "'", "é", "9", "!!", "   ", "👍", " new words here"]


def applied(text, edits):
    now = text or ""
    for e in edits:
        if e is None:
            continue
        s = min(max(e[0] or 0, 0), len(now))
        now = now[:s] + (e[2] or "") + now[s + min(max(e[1] or 0, 0), len(now) - s) :]
    return now


def test_rounds_of_edits_on_kept_trees(spark):
    own = token_counts.Counter(*PATH)
    r = np.random.default_rng(21)
    texts = {i: t for i, (_, t, *_) in enumerate(edge_docs())}
    trees = common.stash(token_counts.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), *PATH))
    for _ in range(3):
        rows = []
        for i, t in texts.items():
            for k in range(int(r.integers(0, 5))):
                rows.append((i, k, int(r.integers(-2, len(t or "") + 5)), int(r.choice([0, 1, 3, 20])), "".join(r.choice(BITS, r.integers(0, 4)))))
        edits = spark.createDataFrame(rows, "doc_id long, seq int, start long, remove long, insert string")
        trees = common.stash(token_counts.edit_trees(token_counts.with_edits(trees, edits), *PATH))
        by_id = {i: [x[2:] for x in sorted(rows) if x[0] == i] for i in texts}
        texts = {i: applied(t, by_id[i]) if by_id[i] else t for i, t in texts.items()}
        for x in trees.collect():
            assert (x.text or "") == (texts[x.doc_id] or "")
            assert (x.tokens[0], x.chars[0]) == (len(own.coder.encode_ordinary(x.text or "")), len(x.text or ""))
            assert (x.n_recoded > 0) <= bool(by_id[x.doc_id]) and x.n_recoded <= 60 * max(len(by_id[x.doc_id]), 1) + 40


def test_an_edit_recodes_its_region_only(spark):
    text = "some plain words, again and again. " * 3000
    docs = spark.createDataFrame([(1, text, [(50_000, 4, "other"), None, (10, 0, "x")])], "doc_id long, text string, edits array<struct<start: long, remove: long, insert: string>>")
    own = token_counts.Counter(*PATH)
    x = token_counts.count_edited(docs, *PATH).first()
    assert x.n_tokens == len(own.coder.encode_ordinary(text)) and x.n_recoded < 120 < x.n_pretokens
    assert x.n_tokens_edited == len(own.coder.encode_ordinary(applied(text, [(50_000, 4, "other"), (10, 0, "x")])))
    kept = token_counts.build_trees(docs, *PATH).join(docs.select("doc_id", "edits"), "doc_id")
    y = token_counts.edit_trees(kept, *PATH).first()
    assert (y.tokens[0], y.n_recoded) == (x.n_tokens_edited, x.n_recoded)


def test_planned_edits_against_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("edits", token_counts.planned_edits())
    own = token_counts.Counter(*PATH)
    got = {x.doc_id: x for x in token_counts.count_edited(docs, *PATH).collect()}
    for x in docs.collect():
        assert got[x.doc_id].n_tokens_edited == len(own.coder.encode_ordinary(applied(x.text, x.edits)))


def test_null_edits_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", [None, (None, None, None)]), (None, "a b", [(1, 1, "c")])], "doc_id long, text string, edits array<struct<start: long, remove: long, insert: string>>")
    got = sorted((x.doc_id or 0, x.n_tokens, x.n_tokens_edited) for x in token_counts.count_edited(docs, *PATH).collect())
    assert got[1:] == [(1, 0, 0), (2, 0, 0)] and got[0][1] == 2
    trees = token_counts.build_trees(docs, *PATH)
    none = spark.createDataFrame([], "doc_id long, seq int, start long, remove long, insert string")
    same = token_counts.edit_trees(token_counts.with_edits(trees, none), *PATH)
    assert sorted(map(repr, same.drop("n_recoded").collect())) == sorted(map(repr, trees.collect()))
    assert token_counts.edit_trees(token_counts.with_edits(trees.limit(0), none), *PATH).count() == 0
