"""The whole pipeline against its stages by hand, and the tables that it leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locuspark.llm import common, langid, mixing, pieces, secret_scan
from tests.llm.test_llm import DOCS, closure, edge_docs, sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and gave, by rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.stash(stage(spark, docs, SF), "by_hand")
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return sorted((x.doc_id, x.text) for x in df.select("doc_id", "text").collect())


def test_run_gives_what_the_stages_give(spark, steps):
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, steps[-1][2].collect())) and whole


def test_language_keeps_all_with_letters(steps):
    _, before, after = steps[0]
    with_letters = before.where(F.col("text").rlike(r"\p{L}"))
    assert texts(after) == texts(with_letters)


def test_dedup_keeps_the_first_of_each_group(steps):
    _, before, after = steps[1]
    by_id = {d: sets(t) for d, t in texts(before)}
    ids = sorted(by_id)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if by_id[a] and 100 * len(by_id[a] & by_id[b]) >= 75 * len(by_id[a] | by_id[b])]
    top = closure(ids, linked)
    assert sorted(x.doc_id for x in after.collect()) == [i for i in ids if top[i] == i]


def test_secrets_are_covered_and_nothing_else(steps):
    _, before, after = steps[2]
    found = {}
    for x in secret_scan.scan(before).where("is_secret").collect():
        found.setdefault(x.doc_id, set()).add(x.candidate)
    want = []
    for d, t in texts(before):
        for c in sorted(found.get(d, ()), key=lambda c: (-len(c), c)):
            t = t.replace(c, "[SECRET]")
        want.append((d, t))
    assert texts(after) == want and all(x.n_chars == len(x.text) for x in after.collect())


def test_mixture_repeats_as_counted(steps):
    _, before, after = steps[3]
    counted = {x.doc_id: x.copies for x in mixing.mix_counts(before).collect()}
    have = {d: t for d, t in texts(before)}
    assert texts(after) == sorted((d, have[d]) for d, n in counted.items() for _ in range(n))


def test_pieces_decode_to_the_mixture(steps):
    _, before, after = steps[4]
    assert texts(pieces.decode_pieces(after, pieces.model_path())) == texts(before)


def test_earlier_tables_go_and_those_in_use_stay(spark):
    docs = spark.createDataFrame(edge_docs(), DOCS)
    corpus_pipeline.STAGES[0][1](spark, docs, "").collect()
    before = [p.removeprefix("file:") for p in corpus_pipeline._kept]
    assert before and all(map(os.path.exists, before))
    held = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert not any(map(os.path.exists, before))
    rows = held.count()
    after = corpus_pipeline.STAGES[3][1](spark, held, "")
    assert after.count() >= 0 and held.count() == rows


def test_verdicts_do_not_depend_on_ids(spark):
    rows = [(None, "the words of a plain text " * 5, "en", "a", 1), (None, "12 34", "en", "a", 1), (1, "the words of a plain text " * 5, "en", None, 1), (1, "...", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted((x.doc_id or 0, x.source or "") for x in langid.accepted(docs).collect()) == [(0, "a"), (1, "")]
