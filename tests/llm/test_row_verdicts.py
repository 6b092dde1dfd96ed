"""Language ID and mixing decide for each row, also where ids are null or repeat."""

from pyspark.sql import functions as F

from locuspark.llm import langid, mixing


def test_only_the_rejected_rows_go(spark):
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = clean.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(7)).when(F.col("doc_id") % 3 == 2, F.col("doc_id")).cast("long"))
    bad = clean.limit(1).withColumn("text", F.lit("12345 678"))
    odd = bad.withColumn("doc_id", F.lit(None).cast("long")).union(bad.withColumn("doc_id", F.lit(7).cast("long")))
    out = langid.accepted(clean.union(odd))
    assert out.where(F.col("text") == "12345 678").isEmpty()
    assert out.count() >= 0.97 * clean.count()


def test_mix_takes_what_is_counted_for_alike_rows(spark):
    rows = [(None if i % 3 else i, f"a{i} b", f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda df, c: {x[0]: x[1] for x in df.groupBy("source").agg(F.sum(c)).where(f"sum({c}) > 0").collect()}
    mixed = mixing.mix(docs).withColumn("two", F.lit(2))
    assert words(mixed, "two") == words(mixing.mix_counts(docs), "taken")
