"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from softgrove.llm.common import read
from softgrove.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.assess(docs, model).filter("__quality.kept").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the largest id."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of fingerprints of three-word shingles within two bits: the smallest id."""
    return simhash_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.emitted(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences without padding, with their token ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).select(
        F.col("id").alias("doc_id"), "start", "length", "bucket", "sequence_id", "offset", "doc_tokens", "ids")
