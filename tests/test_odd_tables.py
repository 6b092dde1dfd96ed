"""Queries against their SQL on rows that the test tables lack."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from locuspark import catalog
from locuspark.functions import codes
from locuspark.operators import sequences
from tests.test_oracles import rows

TEXTS = [None, "", "acgtACGT", "İ", "İİacg", "x" * 39 + "İacgt", "a\U0001F469‍\U0001F466CG", "éT", "ÅﬁK", "漢字", " \t\n", "a\r\nc", "héllo ~~!"]


def same_rows(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours, theirs = catalog.queries()[name](spark, str(folder)).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))
    return ours


def documents(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_codes_of_empty_texts_and_long_lower_cases(spark, tmp_path):
    got = same_rows(spark, tmp_path, "char_codes", documents=documents(spark, TEXTS))
    assert {0, 1}.isdisjoint(got.doc_id) and got[got.doc_id == 3].n.tolist() == [1]


def test_codes_of_whole_texts(spark, tmp_path):
    got = same_rows(spark, tmp_path, "char_codes", documents=documents(spark, ["x" * 60 + "aACGT" * 50_000, "\U0001F469" * 70 + "Tt"]))
    assert sorted(map(tuple, got[["doc_id", "code", "n"]].values.tolist())) == [(0, -1, 60), (0, 0, 100_000), (0, 1, 50_000), (0, 2, 50_000), (0, 3, 50_000), (1, -1, 70), (1, 3, 2)]


def test_code_counts_are_those_of_codes(spark):
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, "a]b^c-d\\e&&[[", "^^-]"]], "t string")
    for letters in ("acgtACGT", "]^-\\&[", "T"):
        for r in texts.select(codes.char_codes(F.col("t"), letters).alias("each"), codes.code_counts(F.col("t"), letters).alias("n")).collect():
            assert dict(r.n) == Counter(r.each or [])


def test_packed_counts_at_the_limits_of_their_bits(spark, tmp_path):
    # On contig 0, the reference has A at 0, T at 1, 5 and 9, and G at 2 and 6.
    reads = {0: 5000, 1: 300, 5: 255, 9: 256, 2: 4096, 6: 4095}
    lines = [("R", "F", 1, 1, pos, 3, 30.0, 0.05) for pos, n in reads.items() for _ in range(n)]
    table = spark.createDataFrame(lines, "l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    got = same_rows(spark, tmp_path, "pack_counts", lineitem=table)
    assert sorted(zip(got.pos, got.c0, got.c1, got.c2, got.c3)) == [(0, 5000, 0, 0, 0), (5, 0, 0, 0, 255), (6, 0, 0, 4095, 0)]


def test_recoded_qualities_of_empty_texts(spark, tmp_path):
    got = same_rows(spark, tmp_path, "fastq_recode", documents=documents(spark, TEXTS[1:]))
    assert got.set_index("doc_id").n.loc[[0, 1, 2, 9]].tolist() == [0, 8, 0, 0]
    recoded = spark.createDataFrame([("",), (None,), ("!@~",)], "q string").select(sequences.recode_quality(F.col("q"), -40).alias("q"))
    assert [r.q for r in recoded.collect()] == ["", None, "\0" + chr(24) + chr(86)]
