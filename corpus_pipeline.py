"""The corpus pipeline: documents in, training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm.common import table, written
from storyloom.llm.decontamination import decontamination_stage
from storyloom.llm.near_duplicates import jaccard_stage
from storyloom.llm.packing import packing_stage
from storyloom.llm.quality import quality_stage
from storyloom.llm.secrets import secrets_stage

#: (name, function) in order; a function takes (spark, docs, sf_dir), and what it returns is the next one's docs.
STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Trained classifiers and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
