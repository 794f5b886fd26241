"""The corpus pipeline: documents go through five stages, each a call of one
operator of ``ledgerlens.llm``. A stage's rows are written as Parquet and read
again as the next one's documents.

All stages but the last return the columns of documents; the last returns
doc_id, n_tokens and the digests of the ids and of the decoded text, a row for
each copy that the mix takes. Null and empty texts fail the quality stage.
Empty tables give empty results. ``ORACLE_SQL`` is None: SQL can't learn a
decision list or encode text."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import mix_sources, quality_rules, simhash, suffix_merge, word_table
from ledgerlens.session import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.learned(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat; n_chars follows the text."""
    got = suffix_merge.without_repeats(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_sources.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document, as digests."""
    return word_table.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = shared_path(spark, "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
