"""A corpus pipeline: each stage works on all that the stage before it kept.

Defined results: null and empty texts are one text, of which the row of the largest doc_id stays; of rows that repeat both id and
text one stays; a null id is a document below all others; of equal similarity no choice arises, since a group of near-duplicates
keeps its smallest doc_id; very long texts are read whole; columns beyond doc_id and text are carried, whatever their names, until
the last stage, which returns counts and digests; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorewright.llm import decontaminate, exact_dedup, near_dedup, sentencepieces, textkit, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one of the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return sentencepieces.encoded(docs, PIECES)


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("near_dedup", dissimilar), ("decontamination", untested), ("sentencepiece", encode)]

#: Learned trees and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = textkit.workspace(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
