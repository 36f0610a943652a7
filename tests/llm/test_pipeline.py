"""The pipeline's stages, each on its own input and all together."""

import corpus_pipeline
from pyspark.sql import functions as F

from .test_corpus import SF, odd_documents


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang_pred", F.lit(1)).withColumn("key", F.lit("k"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() > 0


def test_stages_on_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark), SF).count() > 0, name
        assert stage(spark, odd_documents(spark).limit(0), SF).count() == 0, name


def test_run_covers_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r["doc_id"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == left
    assert len(left) == docs.count()
