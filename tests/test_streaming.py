from locuspark.operators import filters, tally
from locuspark.sources import adapters
from locuspark.streaming import incremental
from tests.conftest import SMALL


def test_incremental_counts_equal_the_batch(spark, tmp_path):
    reads = adapters.reads(spark, SMALL).repartition(3)
    reads.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        incremental.stream_base_counts(spark, str(tmp_path / "in"), reads.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = tally.count_bases(reads.where(filters.keep_reads(10)))
    got = incremental.read_base_counts(spark, str(tmp_path / "out"))
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_mates_wait_for_each_other(spark, tmp_path):
    spark.createDataFrame([("f1", 5), ("f2", 9), ("f1", 2)], "fragment string, pos int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fragment string, pos int").parquet(str(tmp_path / "in"))
    q = incremental.pair_mates(stream).writeStream.format("memory").queryName("mates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.fragment, r.pos1, r.pos2) for r in spark.table("mates").collect()] == [("f1", 2, 5)]
