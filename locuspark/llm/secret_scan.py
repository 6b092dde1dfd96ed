"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A pattern finds what follows a word such as `token =`, also as a part of a longer name
(`DB_PASSWORD=`), or `Bearer`, known key formats, private keys through their END line, and other
runs of 20 or more key characters with a digit. Each candidate gets features: length, shares of
character kinds, transitions between kinds, the mean log probability of its letter transitions,
distinct characters, coverage by dictionary words, signs of a path, and words that stand near
it. A random forest, fitted on FINDINGS labelled findings that training_findings() makes from a
seed, tells secrets from other strings.

Dictionary and transitions come from all documents by grouped aggregation: words are letters
that stand alone between white space, but for signs around them, in MIN_DOCS documents at
least, and transitions are those of adjoining letters a to z in words. The labelled findings
take their plain words from the most frequent of them.

Null and empty texts have no candidates. A U+0001 counts as a space. Rows with equal texts are
covered alike; nothing depends on ids. Everything runs in the JVM; of the corpus only VOCABULARY
words and the transitions, at most 26 * 26 rows, come to the driver.
"""

from __future__ import annotations

import json
import random
import string
from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.common import fresh_name, if_bounded, stash, table

FINDINGS, TREES, DEPTH, SEED, MARK = 3000, 20, 7, 5, "\x01"
#: Documents that a dictionary word stands in, at least; words that labelled findings draw from.
MIN_DOCS, VOCABULARY = 3, 1000
WORD = r"(?<!\S)[^\p{L}\s]{0,4}+(\p{L}{3,24}+)[^\p{L}\s]{0,4}+(?!\S)"
KEY_WORD = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer)"
NAMED = rf"""(?i:(?<![A-Za-z0-9]){KEY_WORD}(?:[_-][A-Za-z0-9]{{1,20}}){{0,3}}["']?\s{{0,3}}[:=]\s{{0,3}}["']?(?:bearer\s{{1,3}})?|\bbearer\s{{1,3}}["']?)"""
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\\\s:,-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|" + PEM
)
OTHER = r"(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
CANDIDATE = rf"""({NAMED})({PEM}|[^\s"'{MARK}]{{6,}}+)|(?<![A-Za-z0-9+/_=-])({FORMATS}|{OTHER})"""
#: Words that stand in for a corpus too small to have its own, and in names of the findings.
COMMON = (
    "about access account admin after api app auth base before book build chapter change class client cloud code commit config content data "
    "date default demo dev digest doc document dummy example false file first foo bar from hash have here home html http https image index "
    "info item java key lib license line link list local login main make module my name null number object of on order page part password "
    "path place holder plain post private product project public python release report resource sample script secret section server service site size "
    "source src static string style system table temp test text the this title token true type update upload user usr value version "
    "view web with word work world year your".split()
)
SECRET_WORDS = r"(?i)token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|bearer|private"
PLAIN_WORDS = r"(?i)example|sample|dummy|placeholder|sha-?\d|md5|commit|checksum|uuid|guid|digest|hash|integrity|changeme|your|xxxx|base64,|isbn|https?:"
FEATURES = ["length", "digits", "uppers", "lowers", "others", "turns", "flow", "distinct", "covered", "slashes", "dotted", "named", "plain", "format", "hex", "joined"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 0), before, candidate, after for each candidate of docs (doc_id, text)."""
    marked = F.regexp_replace(F.replace(F.col("text"), F.lit(MARK), F.lit(" ")), CANDIDATE, rf"$1{MARK}$2$3{MARK}")
    parts = F.split("marked", MARK)
    found = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("parts") / 2).cast("int") - 1),
        lambda i: F.struct(
            i.alias("ordinal"),
            F.right(F.col("parts")[2 * i], F.lit(48)).alias("before"),
            F.col("parts")[2 * i + 1].alias("candidate"),
            F.left(F.col("parts")[2 * i + 2], F.lit(24)).alias("after"),
        ),
    )
    return (
        docs.select("doc_id", marked.alias("marked"))
        .where(F.instr("marked", MARK) > 0)
        .select("doc_id", parts.alias("parts"))
        .select("doc_id", F.explode(found).alias("f"))
        .select("doc_id", "f.*")
    )


def corpus_words(docs: DataFrame) -> DataFrame:
    """word and docs, the number of documents it stands in, for the dictionary of docs (text)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)))
    words = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    return stash(words.where(F.col("docs") >= MIN_DOCS), "words")


def transitions(words: DataFrame) -> dict[str, float]:
    """Log2 probability of the second letter after the first, for pairs of letters a to z in words."""
    n = F.length("word")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr("word", i, F.lit(2)))
    counted = words.select(F.explode(pairs).alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").count().collect()
    seen = {r["pair"]: r["count"] for r in counted}
    firsts = {a: sum(seen.get(a + b, 0) for b in string.ascii_lowercase) for a in string.ascii_lowercase}
    return {a + b: log2((seen.get(a + b, 0) + 1) / (firsts[a] + 26)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds covered_, the letters of a candidate in runs that are dictionary words.

    found is a stashed table; each distinct candidate is looked up once.
    """
    runs = F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{3,}"), F.lit(0))
    each = found.select("candidate").distinct().select("candidate", F.explode(runs).alias("word"))
    known = each.join(if_bounded(words, "word"), "word").groupBy(F.col("candidate").alias("of_")).agg(F.sum(F.length("word")).alias("covered_"))
    known = stash(known, "covered")
    joined = found.join(if_bounded(known, "of_"), found["candidate"] == known["of_"], "left")
    return joined.drop("of_").withColumn("covered_", F.coalesce("covered_", F.lit(0)))


def with_features(found: DataFrame, flow: dict[str, float]) -> DataFrame:
    """Adds the columns FEATURES to rows with before, candidate, after and covered_."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def count(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    table_ = F.from_json(F.lit(json.dumps(flow)), "map<string,double>")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.lower(c), i, F.lit(2)))
    logs = F.filter(F.transform(pairs, lambda x: F.element_at(table_, x)), lambda x: x.isNotNull())
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return found.withColumns(
        {
            "length": n,
            "digits": count("[0-9]") / n,
            "uppers": count("[A-Z]") / n,
            "lowers": count("[a-z]") / n,
            "others": count("[^A-Za-z0-9]") / n,
            "turns": count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / n,
            "flow": total / F.greatest(F.size(logs), F.lit(1)),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
            "covered": F.col("covered_") / n,
            "slashes": count("/") + count("[/.]$", before),
            "dotted": count(r"\.[a-z]{2,4}\b") + count(r"^\.[a-z]{2,4}\b", after),
            "named": count(SECRET_WORDS, before),
            "plain": count(PLAIN_WORDS, F.concat_ws(" ", before, c, after)),
            "format": count(f"^(?:{FORMATS})$"),
            "hex": count("^[0-9a-fA-F-]+$"),
            "joined": count("[-_]") / n,
        }
    ).drop("covered_")


def training_findings(n: int = FINDINGS, seed: int = SEED, words: list[str] | None = None) -> list[dict]:
    """Labelled findings of many shapes: before, candidate, after, label (1: secret).

    Plain words are drawn from `words`, those of a corpus, and COMMON.
    """
    r = random.Random(seed)
    own = [w for w in words or [] if w.isascii()]
    dictionary = own + COMMON if len(own) < 100 else own
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def text(letters: str, lo: int, hi: int | None = None) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(lo, hi or lo)))

    def prose() -> str:
        return " ".join(r.choice(dictionary) for _ in range(r.randint(1, 5)))

    def hexes(*lengths: int) -> str:
        return text("0123456789abcdef", r.choice(lengths))

    def slug() -> str:
        return r.choice("-_/").join([*(r.choice(dictionary) for _ in range(r.randint(3, 6))), str(r.randint(1, 2030))])

    def pem() -> str:
        kind = r.choice(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""])
        return "\n".join([f"-----BEGIN {kind}PRIVATE KEY-----", *(text(b64, 64) for _ in range(r.randint(2, 25))), text(b64, 20, 60) + "==", f"-----END {kind}PRIVATE KEY-----"])

    def short() -> str:
        found = list(text(alnum, 5, 9) + text(string.digits, 1, 4) + text("!@#$%^&*_-", 0, 2))
        r.shuffle(found)
        return "".join(found)

    def long_name() -> str:
        parts = [r.choice(["db", "app", "my", "admin", "aws", "auth", "user", "client"]), r.choice(["password", "secret", "token", "passwd", "api_key"])]
        found = r.choice(["_", "-"]).join(r.choice([parts, [parts[1], r.choice(["key", "value", "prod"])]]))
        return r.choice([found, found.upper()])

    bearer = lambda: r.choice(["Authorization: Bearer ", "authorization: bearer ", 'Authorization": "Bearer '])
    name = lambda: r.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "passwd", "Bearer"])
    sign = lambda: r.choice([" = ", ": ", "=", ":"])
    quote = lambda: r.choice(['"', "'", ""])
    secret = [
        lambda: (f"{name()}{sign()}{quote()}", hexes(32, 40, 64)),
        lambda: (f"{name()}{sign()}{quote()}", text(alnum, 20, 44)),
        lambda: (f"{name()}{sign()}{quote()}", text(alnum + "!@#$%^&*_-", 10, 24)),
        lambda: (f"{name()}{sign()}{quote()}", text(b64, 30, 60) + r.choice(["", "=", "=="])),
        lambda: (f"{prose()} ", r.choice(["AKIA", "ASIA"]) + text(string.ascii_uppercase + string.digits, 16)),
        lambda: (f"{prose()} ", r.choice(["ghp_", "gho_", "ghs_"]) + text(alnum, 36)),
        lambda: (f"{prose()} ", "sk-" + text(alnum, 24, 48)),
        lambda: (f"{prose()} ", "xoxb-" + text(string.digits, 11) + "-" + text(alnum, 24)),
        lambda: (f"{prose()} ", "AIza" + text(alnum + "_-", 35)),
        lambda: (f"{prose()} ", "eyJ" + text(alnum, 20) + "." + text(alnum, 40) + "." + text(alnum, 30)),
        lambda: (f"{prose()} ", r.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"])),
        lambda: (f"{prose()} ", pem()),
        lambda: (f"{long_name()}{sign()}{quote()}", r.choice([short(), text(alnum, 12, 40), hexes(10, 16, 32)])),
        lambda: (f"{name()}{sign()}{quote()}", short()),
        lambda: (bearer(), r.choice([short(), text(string.ascii_lowercase, 5, 8) + text(string.digits, 2, 5), hexes(10, 16, 32, 40), text(alnum, 20, 60)])),
    ]
    other = [
        lambda: (f"{prose()} {r.choice(['commit', 'sha256', 'sha1:', 'md5', 'checksum', 'digest'])} ", hexes(32, 40, 64)),
        lambda: (f"{r.choice(['id', 'uuid', 'guid', 'ref'])}{sign()}", "-".join(hexes(k) for k in (8, 4, 4, 4, 12))),
        lambda: (f"{prose()} ", slug()),
        lambda: (f"https://{text(string.ascii_lowercase, 4, 9)}.com/", slug()),
        lambda: (f"{prose()} ", "/" + "/".join(r.choice(dictionary) for _ in range(5)) + f"/{r.choice(dictionary)}{r.randint(1, 99)}"),
        lambda: (f"{name()}{sign()}{quote()}", r.choice(["your_token_here_1234", "changeme123", "placeholder_secret_1", "example-password-01", "xxxxxxxxxxxxxxxx1", "dummytoken0000"])),
        lambda: (f"{name()}{sign()}{quote()}", r.choice(dictionary) + r.choice("._(") + r.choice(dictionary)),
        lambda: (f"{name()}{sign()}", text(string.ascii_lowercase, 6, 12) + r.choice([",", ".", ""])),
        lambda: (f"{long_name()}{sign()}{quote()}", r.choice([r.choice(dictionary) + r.choice("._(") + r.choice(dictionary), text(string.ascii_lowercase, 6, 12), "changeme123", "your_password_1"])),
        lambda: (f"{prose()} bearer ", text(string.ascii_lowercase, 6, 12) + r.choice([",", ".", ""])),
        lambda: (f"{prose()} ", r.choice("0123456789xX=-_") * r.randint(20, 60) + "1"),
        lambda: (f"{prose()} ", text(string.digits, 20, 30)),
        lambda: ("data:image/png;base64,", text(b64, 60, 200)),
        lambda: (f"{prose()} ", text(string.ascii_lowercase, 18, 30) + str(r.randint(0, 99))),
        lambda: (f"{prose()} ", "=" * 10 + str(r.randint(1900, 2030)) + "=" * 12),
    ]
    out = []
    for i in range(n):
        before, found = r.choice(secret if i % 2 else other)()
        out.append({"before": before[-48:], "candidate": found, "after": r.choice(['" ', "' ", " ", "\n"]) + prose()[:20], "label": float(i % 2)})
    return out


class Scanner:
    """Dictionary and transitions of a corpus, and the forest fitted on findings with its words."""

    def __init__(self, docs: DataFrame, findings: list[dict] | None = None):
        spark = docs.sparkSession
        self.words = corpus_words(docs)
        self.flow = transitions(self.words)
        if findings is None:
            frequent = self.words.orderBy(F.desc("docs"), "word").limit(VOCABULARY).collect()
            findings = training_findings(words=[r["word"] for r in frequent])
        kind = "array<struct<before string, candidate string, after string, label double>>"
        rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(findings)), kind)).alias("i", "f"))
        held = self.featured(stash(rows.select("i", "f.*"), "findings"))
        # One partition in a fixed order, as the forest's draws follow the rows.
        held = stash(held.select("i", "label", *FEATURES).orderBy("i").coalesce(1), "findings")
        named = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(held)
        self.forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(named.select("features", "label"))

    def featured(self, found: DataFrame) -> DataFrame:
        return with_features(with_coverage(found, self.words), self.flow)

    def scored(self, found: DataFrame) -> DataFrame:
        """found (a stashed table of candidates) with score and is_secret."""
        named = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.featured(found))
        kept = [c for c in found.columns if c not in ("before", "after")]
        return self.forest.transform(named).select(
            *kept, F.round(vector_to_array("probability")[1], 6).alias("score"), (F.col("prediction") == 1.0).alias("is_secret")
        )


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, ordinal, candidate, score and is_secret for every candidate of docs (doc_id, text)."""
    return (scanner or Scanner(docs)).scored(stash(candidates(docs), "candidates"))


def redact(docs: DataFrame, cover: str = "[SECRET]") -> DataFrame:
    """docs with every secret in its text covered and n_chars, if there, counted anew where that changed it.

    Secrets are found by text, so that rows need no ids, and equal texts share theirs; a row
    gathers no more than the secrets of one text.
    """
    secrets, key = fresh_name(docs, "secrets_"), fresh_name(docs, "found_in_")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = scan(texts).where("is_secret").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("candidate").alias(secrets))
    found = stash(found, "secrets")
    longest = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    text = F.aggregate(F.array_sort(secrets, longest), F.col("text"), lambda t, s: F.replace(t, s, F.lit(cover)))
    joined = docs.join(if_bounded(found, secrets), F.xxhash64(docs["text"]) == found[key], "left")
    changed = F.col(secrets).isNotNull() & docs["text"].isNotNull()
    new = {"text": F.when(changed, text).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(docs["n_chars"])
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


QUERIES = {"op6_secret_scan": query}
ORACLES: dict[str, str] = {}
