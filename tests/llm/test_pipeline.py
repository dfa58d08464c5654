"""The pipeline's stages one by one and together."""

import os

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = os.path.join(str(tmp_path), str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] >= counts[3] == docs.select("doc_id").distinct().count() and counts[5] == counts[4]
    assert {"shard", "slot", "text"} <= set(docs.columns)


def test_run_gives_the_same_rows_every_time(spark):
    a = corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect()
    b = corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b) and a
