"""A corpus from raw documents to token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoptide.llm import stages
from shoptide.llm.common import saved, table

STAGES = [
    ("language", stages.known_languages),
    ("near duplicates", stages.without_near_copies),
    ("secrets", stages.without_secrets),
    ("mixing", stages.mixed),
    ("tokens", stages.tokens),
]

ORACLE_SQL = None  # language models, sampled signatures and token ids are beyond SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
