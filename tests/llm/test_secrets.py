"""Secrets: findings held out, those planted in the documents, and the tables built from the corpus."""

import re

import pytest
from pyspark.sql import functions as F

from locuspark.llm import secret_scan

SF = "/root/testdata/sf0.01"
PLANTED = re.compile(r'(?<![0-9a-zA-Z])token = "([0-9a-f]{40})"|(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Z0-9])|password=([0-9a-zA-Z]{10,})')


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def scanner(corpus):
    return secret_scan.Scanner(corpus)


def test_findings_held_out(spark, scanner):
    words = [r["word"] for r in scanner.words.orderBy(F.desc("docs"), "word").limit(1000).collect()]
    held = secret_scan.training_findings(1000, 99, words)
    texts = spark.createDataFrame([(i, f["before"] + f["candidate"] + f["after"], f["label"]) for i, f in enumerate(held)], "doc_id long, text string, label double")
    found = secret_scan.scan(texts, scanner).where("is_secret").select("doc_id").distinct()
    hits = texts.join(found, "doc_id").toPandas()
    assert hits.label.sum() >= 0.9 * sum(f["label"] for f in held) and (hits.label == 0).sum() <= 0.05 * len(held)


def test_planted_secrets(corpus, scanner):
    planted = {(x.doc_id, next(g for g in m if g)) for x in corpus.collect() for m in PLANTED.findall(x.text or "")}
    found = {(x.doc_id, x.candidate) for x in secret_scan.scan(corpus, scanner).where("is_secret").collect()}
    strip = {(d, c.rstrip(".,;!*#$%&")) for d, c in found}
    assert len(planted) >= 10
    assert len(planted & strip) >= 0.98 * len(planted)
    assert len(strip & planted) >= 0.95 * len(strip)


def test_words_and_transitions_against_plain_counts(spark):
    texts = ["The cat, the dog!", "cat dog x1cat", "cat (dog) the", None, "", 'token = "catcat99" dog']
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = secret_scan.corpus_words(docs)
    assert {r["word"]: r["docs"] for r in words.collect()} == {"cat": 3, "dog": 4}
    flow = secret_scan.transitions(words)
    assert flow["ca"] == pytest.approx(-3.7548875) and flow["zz"] == pytest.approx(-4.7004397)
    found = secret_scan.stash(spark.createDataFrame([("cat-99-dogcat",), ("dog_CAT",), ("",)], "candidate string"))
    assert {r["candidate"]: r["covered_"] for r in secret_scan.with_coverage(found, words).collect()} == {"cat-99-dogcat": 3, "dog_CAT": 6, "": 0}


def test_rows_without_ids_or_counts(spark):
    key = "a3f1c29b7de04856b1aa90c34de77f0192ab34cd"
    rows = [(None, f'token = "{key}"'), (None, "plain words"), (1, f'token = "{key}"'), (1, "x"), (2, None), (2, "")]
    got = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(d, t and t.replace(key, "[SECRET]")) for d, t in rows]))
