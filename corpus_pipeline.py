"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import quire.llm.stages as stages

#: (name, function) in order; each function takes (spark, docs, sf_dir). All but the last return documents' columns.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_dedup),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: Learned rules, a trained classifier and packing by a tokenizer are beyond SQL; tests/llm runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stages.stored(docs, name)
    return docs
