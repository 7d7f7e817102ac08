"""From raw documents to token ids: quality, near-duplicates, decontamination, mixing, output.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``, and carry others along.

Null texts are empty ones; null ids are kept as they are; repeated rows are judged alike, of which near-duplicates leave one. An empty
table passes every stage empty. Ties and columns with clashing names: see the operator that each stage calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paceline.llm import decontaminate, huffman, mixing, quality, simhash
from paceline.llm.common import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash."""
    return simhash.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn for their source's target weight, in shuffled order."""
    return mixing.mix(docs).drop("copy", "shuffle_key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Huffman blocks, read back: place, number and checksum of each document's ids."""
    return huffman.token_output(docs, public_tokenizers.path(huffman.VOCABULARY))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("decontamination", keep_clean),
    ("mixing", mix),
    ("token_output", tokens),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds every stage against a plain loop over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs), sf_dir)
    return docs
