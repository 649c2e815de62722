"""The corpus pipeline: raw documents to token files, five stages that each apply one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlab.llm import decontaminate, mixing, near_copies, quality, token_output
from flowlab.sources.staging import stage

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more: links of SimHash
    fingerprints, verified, and those that MinHash finds beyond three bits."""
    return near_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return decontaminate.cleaned(docs, benchmark)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document written."""
    return token_output.written_and_read(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("qgram_decontamination", decontamination),
    ("systematic_mixing", source_mixing),
    ("token_ids", token_ids),
]

# Fingerprints, alignments and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
