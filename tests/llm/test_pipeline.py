"""The pipeline on the smallest tables and on odd documents."""

import corpus_pipeline as p
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "zz", 0), (10**9 + 1, "123 456", None, "zz", 7)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(odd)
    counts = [docs.count()]
    for name, stage in p.STAGES:
        new = stage(spark, docs, SF).cache()
        assert set(new.columns) >= set(docs.columns)
        docs = new
        counts.append(docs.count())
        if name != p.STAGES[-1][0]:
            assert new.columns == ["doc_id", "text", "lang", "source", "n_chars"] and counts[-1] <= counts[-2]
    assert docs.where(F.col("text").isNull()).count() == 0 and counts[3] > 100
    assert docs.agg(F.max("copy")).first()[0] <= 2


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 100
