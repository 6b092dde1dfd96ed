"""Language of pages and documents by Bayesian fusion of evidence.

The text gives log likelihoods under models of byte trigrams, one a language, which are
fitted on a bounded sample of labelled documents (SAMPLE rows, those with the smallest hash of
their id). Neighbouring trigrams repeat each other's evidence, so a text counts as EFFECTIVE
trigrams of its mean likelihood at most. Grouped sums of the texts' posteriors over all rows
give the other evidence: how often each language declares each markup language, and a prior
that is smoothed in levels, a host's mixture toward its domain's, that toward what the address
suffix says, and that toward the whole table's. Each row's own share is taken out of the sums
that it meets, so a text speaks once. The posterior is the normalised product of the text's
likelihood, the declaration's and the host's prior.

A row is rejected if its text has no letters, if no language fits it (the mean log likelihood
of its best language is below the median of all rows by more than MARGIN + SPREAD / sqrt(its
trigrams), which a text of a few trigrams never is), or if no language has half of the
posterior. Null or empty texts have no letters. Null hosts, domains, suffixes and declarations
are values like others. Languages that tie share the posterior; the first by name is given.
Repeated rows count as often as they come. The driver holds the model: BINS numbers for each
language of the sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import if_bounded, slices, stash, table

SAMPLE, BINS, EFFECTIVE, MARGIN, SPREAD, HOST_WEIGHT, DOMAIN_WEIGHT = 4000, 1 << 16, 200, 6.0, 8.0, 10.0, 50.0
MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,10};")
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: str | None, markup: bool = False) -> np.ndarray:
    """Bins of the byte trigrams of a text that hold a letter."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if markup:
        raw = MARKUP.sub(b" ", raw)
    b = np.frombuffer(b" " + raw.translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = code[(b[1:-1] != 32)]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """The trigram models of a bounded sample of labelled (doc_id, text, lang)."""
    rank = F.xxhash64("doc_id")
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = named.select("doc_id").orderBy(rank, "doc_id").limit(sample)
    rows = named.select("doc_id", "text", "lang").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                t = trigrams(text)
                sums.setdefault(lang, np.zeros(BINS, np.int64))
                sums[lang] += np.bincount(t, minlength=BINS)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(v[at])], names=["lang", "bin", "n"])

    found = rows.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    logs = np.full((len(langs), BINS), 0.05)
    for k, lang in enumerate(langs):
        part = found[found["lang"] == lang]
        logs[k, part["bin"].to_numpy()] += part["n"].to_numpy()
    logs = np.log(logs / logs.sum(axis=1, keepdims=True)).astype(np.float32) if langs else logs.astype(np.float32)
    return {"langs": langs, "logs": logs}


def score(model: dict, text: str | None, markup: bool = False) -> tuple[np.ndarray, float, int]:
    """Posterior of the text alone, mean log likelihood of its best language, trigrams."""
    t = trigrams(text, markup)
    if not len(t) or not model["langs"]:
        n = max(len(model["langs"]), 1)
        return np.full(n, 1.0 / n), 0.0, 0
    mean = model["logs"][:, t].mean(axis=1, dtype=np.float64)
    p = np.exp((mean - mean.max()) * min(len(t), EFFECTIVE))
    return p / p.sum(), float(mean.max()), len(t)


def text_evidence(rows: DataFrame, model: dict, markup: bool) -> DataFrame:
    """rows (id, text, host, domain, suffix, declared) with p, fit and grams for the text; stashed."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["id", "host", "domain", "suffix", "declared"]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [score(held.value, t, markup) for t in batch.column("text").to_pylist()]
            extra = [pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *extra], names=[*kept, "p", "fit", "grams"])

    kinds = "id long, host string, domain string, suffix string, declared string, p array<double>, fit double, grams long"
    return stash(rows.select("id", "text", *kept[1:]).mapInArrow(run, kinds), "evidence")


def _sums(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Sum of the rows' posteriors and number of the rows for each value of a key."""
    total = F.array(*[F.sum(F.col("p")[i]) for i in range(n)])
    return stash(rows.where("grams > 0").groupBy(key).agg(total.alias(f"{key}_c"), F.count("*").alias(f"{key}_n")), "sums")


def fuse(scored: DataFrame, model: dict) -> DataFrame:
    """id, declared, host, lang, posterior and accepted for every row of text_evidence()."""
    n = max(len(model["langs"]), 1)
    heard = F.col("grams") > 0
    found = scored.where(heard).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]), F.percentile_approx("fit", 0.5, 10_000)).first()
    whole = [(x or 0.0) + 1.0 for x in found[0] or [None] * n]
    own = [F.when(heard, F.col("p")[i]).otherwise(0.0) for i in range(n)]
    counted = F.when(heard, 1).otherwise(0)

    def others(key: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(f"{key}_c")[i], F.lit(0.0)) - own[i], F.lit(0.0))

    def likelihood(key: str, kinds: int) -> Column:
        return F.array(*[(others(key, i) + 1.0) / (F.lit(whole[i]) - own[i] + kinds) for i in range(n)])

    def smooth(key: str, toward: str, weight: float) -> Column:
        rows = F.coalesce(F.col(f"{key}_n"), F.lit(0)) - F.when(F.col(f"{key}_n") > 0, counted).otherwise(0)
        return F.array(*[(others(key, i) + weight * F.col(toward)[i]) / (rows + weight) for i in range(n)])

    def normal(column: str) -> Column:
        total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
        return F.transform(column, lambda x: x / total)

    out, kinds = scored, {}
    for key in ("declared", "suffix", "domain", "host"):
        seen = _sums(scored, n, key)
        kinds[key] = seen.count() + 1
        out = out.join(if_bounded(seen, key), out[key].eqNullSafe(seen[key]), "left").drop(seen[key])
    out = out.withColumn("base_", likelihood("suffix", kinds["suffix"]))
    out = out.withColumn("base_", F.array(*[F.col("base_")[i] * (F.lit(whole[i]) - own[i]) for i in range(n)]))
    out = out.withColumn("base_", normal("base_"))
    out = out.withColumn("domain_p", smooth("domain", "base_", DOMAIN_WEIGHT))
    out = out.withColumn("host_p", smooth("host", "domain_p", HOST_WEIGHT)).withColumn("declared_p", likelihood("declared", kinds["declared"]))
    out = out.withColumn("joint", F.array(*[F.col("p")[i] * F.col("declared_p")[i] * F.col("host_p")[i] for i in range(n)]))
    names = F.array(*[F.lit(x) for x in model["langs"] or [None]])
    total = F.aggregate("joint", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max("joint")
    least = (found[1] if found[1] is not None else 0.0) - MARGIN - F.lit(SPREAD) / F.sqrt(F.greatest("grams", F.lit(1)))
    return out.select(
        "id", "declared", "host",
        F.when(heard, names[F.array_position("joint", best).cast("int") - 1]).alias("lang"),
        F.when(total > 0, best / total).otherwise(0.0).alias("posterior"),
        (heard & (F.col("fit") >= least) & (best >= 0.5 * total)).alias("accepted"),
    )


def identify_pages(pages: DataFrame, model: dict) -> DataFrame:
    """fuse() for pages (page_id, url, html)."""
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        F.lower(F.nullif(declared, F.lit(""))).alias("declared"),
    )
    return fuse(text_evidence(rows, model, True), model)


def identify_documents(docs: DataFrame, model: dict) -> DataFrame:
    """fuse() for documents: source stands for the host; lang, which models are fitted on, is no evidence."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"),
    )
    return fuse(text_evidence(rows, model, False), model)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, each by its own text and source, whatever its id.

    Rows with equal texts and sources have equal evidence, so the verdict goes by a 64-bit hash
    of the text, and the source. The sample is drawn by id and text, as ids may be null or
    repeat.
    """
    model = fit(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")))
    found = identify_documents(docs.withColumn("doc_id", F.xxhash64("text")), model)
    gone, text, source = stash(found.where(~F.col("accepted")).select("id", "host").distinct(), "rejected"), docs["text"], docs["source"]
    gone = if_bounded(gone, "id", 1_000_000, 8 << 20)
    return docs.join(gone, (F.xxhash64(text) == gone["id"]) & source.eqNullSafe(gone["host"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "documents"))
    return identify_pages(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id").withColumn("posterior", F.round("posterior", 6))


QUERIES = {"op2_language_id": query}
ORACLES: dict[str, str] = {}
