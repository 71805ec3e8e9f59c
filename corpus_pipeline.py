"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  No stage's decisions can be written
in SQL as a whole (trained models, fingerprints, a tokenizer), so there is no
SQL twin; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import pipeline
from rowloom.llm.common import new_shared_path, table
from rowloom.sources import files

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's output goes through Parquet in the shared folder.

    A stage's output is deleted once the next stage's is written; the last stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark, before)
        before = path
    return docs
