"""A training-corpus pipeline over ``documents``: language ID, line dedup, near-dedup, packing.

Each stage is ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of
``documents``.  :func:`run` keeps the stages' tables in the shared folder of
``spark.checkpoint.dir`` until the driver ends.

Defined results: documents with a null text or one without letters go in the
first stage; of repeated rows one stays in the third; texts that line dedup
leaves empty are one group of near duplicates; nulls in other columns and
columns of any other name are passed on; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright.llm import language_id, line_dedup, packing, simhash
from versewright.llm.common import checkpoint_dir, gone_at_exit, small_batches

#: Share of the commonest language below which a text has no usable language.
LEAST_SHARE = 0.4


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those in which no language has LEAST_SHARE."""
    small_batches(spark)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, named.columns))
    model = language_id.train(named.where(~language_id.held_out(names["doc_id"])), names["doc_id"], names["text"], names["lang"])
    found = language_id.identify(named, model, names["text"], keep_text=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*named.columns).toDF(*docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring template lines out of the texts; ``n_chars`` follows the text."""
    small_batches(spark)
    done = line_dedup.drop_templates(docs)
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(size).select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2,048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", _language), ("line dedup", _lines), ("SimHash near-dedup", _near), ("packing", _pack)]

#: Model inference and tokenisation are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
