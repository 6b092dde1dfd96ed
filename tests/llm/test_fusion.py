"""The fused posterior against plain loops over rows, and rejection of what is no language."""

import numpy as np
from pyspark.sql import functions as F

from locuspark.llm import langid

EVIDENCE = "id long, host string, domain string, suffix string, declared string, p array<double>, fit double, grams long"


def brute(rows, langs):
    n = len(langs)
    out = {}
    for me in rows:
        rest = [r for r in rows if r[0] != me[0] and r[7] > 0]
        own = np.array(me[5]) if me[7] > 0 else np.zeros(n)
        whole = np.ones(n) + sum((np.array(r[5]) for r in rows if r[7] > 0), np.zeros(n)) - own

        def group(at):
            same = [np.array(r[5]) for r in rest if r[at] == me[at]]
            return sum(same, np.zeros(n)), len(same)

        def kinds(at):
            return len({r[at] for r in rows if r[7] > 0}) + 1

        declared = (group(4)[0] + 1) / (whole + kinds(4))
        base = (group(3)[0] + 1) / (whole + kinds(3)) * whole
        base /= base.sum()
        c, k = group(2)
        domain = (c + langid.DOMAIN_WEIGHT * base) / (k + langid.DOMAIN_WEIGHT)
        c, k = group(1)
        host = (c + langid.HOST_WEIGHT * domain) / (k + langid.HOST_WEIGHT)
        joint = np.array(me[5]) * declared * host
        out[me[0]] = joint / joint.sum()
    return out


def test_fusion_against_brute_force(spark):
    r = np.random.default_rng(12)
    langs = ["de", "en", "fr"]
    rows = []
    for i in range(120):
        k = int(r.integers(0, 4))
        host = None if k == 0 else f"{'abc'[i % 3]}.site{k}.{'de' if k % 2 else 'com'}"
        p = r.dirichlet([0.3] * 3)
        grams = int(r.integers(0, 4)) * 50
        rows.append((i, host, host and f"site{k}.{host.rsplit('.')[-1]}", host and host.rsplit(".")[-1], [None, "en", "fr"][int(r.integers(0, 3))], p.tolist() if grams else [1 / 3] * 3, -5.0 - r.random(), grams))
    got = {x.id: x for x in langid.fuse(spark.createDataFrame(rows, EVIDENCE), {"langs": langs}).collect()}
    want = brute(rows, langs)
    for i, *_, grams in rows:
        assert abs(got[i].posterior - want[i].max()) < 1e-9
        assert got[i].lang == (langs[int(want[i].argmax())] if grams else None)
        assert got[i].accepted == (grams > 0 and want[i].max() >= 0.5)


def test_ties_and_repeated_rows(spark):
    rows = [(i, "h", "d", "s", None, [0.5, 0.5], -5.0, 10) for i in range(4)]
    got = langid.fuse(spark.createDataFrame(rows, EVIDENCE), {"langs": ["a", "b"]}).collect()
    assert {(x.lang, round(x.posterior, 9), x.accepted) for x in got} == {("a", 0.5, True)}
    assert langid.fuse(spark.createDataFrame([], EVIDENCE), {"langs": []}).count() == 0


def test_no_language_is_rejected_and_short_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = np.random.default_rng(3)
    noise = ["".join(chr(int(c)) for c in r.integers(0x4E00, 0x9FFF, 400)), "zq" * 300, "1234 5678", "", None]
    short = [x.text.split()[0] for x in docs.where("length(text) > 50").limit(40).collect()]
    extra = spark.createDataFrame([(10**6 + i, t, None, "src0", 1) for i, t in enumerate(noise + short)], docs.schema)
    kept = {x.doc_id for x in langid.accepted(docs.union(extra)).where("doc_id >= 1000000").collect()}
    assert kept == {10**6 + i for i in range(len(noise), len(noise) + len(short)) if any(c.isalpha() for c in short[i - len(noise)])}


def test_pages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(10**6, "http://x.example.fr/", "<html></html>"), (10**6 + 1, None, "<p>" + "the of and " * 20000)], "page_id long, url string, html string")
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    # A page that declares a language is mostly in it; the declaration alone must not decide.
    found = langid.identify_pages(pages.union(extra.select(pages.columns)), model)
    named = found.where(F.col("declared").isNotNull() & F.col("accepted"))
    assert named.where("lang = declared").count() >= 0.9 * named.count()
    got = {x.id: x.accepted for x in found.where("id >= 1000000").collect()}
    assert got == {10**6: False, 10**6 + 1: True}
