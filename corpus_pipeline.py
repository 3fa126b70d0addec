"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import decontam, neardup, packing, pii, quality
from veriframe.llm.common import cut, table

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontam.stage),
    ("personal_data", pii.stage),
    ("packing", packing.stage),
]
# The tokenizer, the fitted model and the packing order cannot be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
