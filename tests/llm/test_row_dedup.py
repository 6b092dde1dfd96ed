"""Near dedup tells rows apart that share an id or have none."""

import corpus_pipeline


def test_dedup_works_on_rows(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    near = texts["b"] + " more"
    rows = [(1, texts["a"]), (1, texts["b"]), (None, texts["c"]), (None, texts["c"]), (None, near), (None, texts["d"]), (5, texts["d"]), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(repr, map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())))
    assert kept == sorted(map(repr, [(1, texts["a"]), (1, texts["b"]), (None, texts["c"]), (5, texts["d"]), (None, ""), (None, None)]))
