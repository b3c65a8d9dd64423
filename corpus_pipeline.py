"""A corpus pipeline of five of the operators: each stage's result is written as Parquet and read by the next.

All stages but the last return the columns of documents. Columns beyond those of documents pass through,
whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import jaccard, mixing, packing, pii, quality
from rankloom.llm.common import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their 5-word shingles, directly or by way of others, the first stays."""
    return jaccard.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get surrogates for personal data; n_chars follows the new text."""
    return pii.rewrite(docs, "rankloom")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, a part of the text where it takes a part."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their token ids: what the mix cut or repeated can't be told from the documents again."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("private_data", replace_private), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express the first stage, nor those after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
