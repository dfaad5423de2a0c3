"""The corpus pipeline: quality rules, exact and near dedup, mixing, packing.

Every stage reads what the stage before it wrote. Without a shared folder named
in spark.checkpoint.dir the session helper makes one on a local master only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from softgrove.llm import pipeline
from softgrove.llm.common import read, written

STAGES = [
    ("quality rules", pipeline.quality_stage),
    ("exact dedup", pipeline.exact_stage),
    ("SimHash near-dedup", pipeline.near_stage),
    ("mixing to target weights", pipeline.mixing_stage),
    ("packing", pipeline.packing_stage),
]

#: The isolation forest, the fingerprints and the tokenizer can't be expressed in SQL; see tests/llm/test_llm_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, from the table ``documents`` of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
