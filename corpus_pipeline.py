"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adweave.llm.common import materialise, table
from adweave.llm.language_id import language_stage
from adweave.llm.mixing import mixing_stage
from adweave.llm.ngram_join import near_duplicate_stage
from adweave.llm.packing import packing_stage
from adweave.llm.secrets import secrets_stage

#: Each takes (spark, docs, sf_dir); its result is written and read as the next one's docs.
STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression sizes, automata and trained classifiers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
