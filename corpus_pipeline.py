"""A training-data pipeline over the documents table; each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm import bpe, decontaminate, pii, simhash, toxicity
from glyphreel.llm.common import shared_folder

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: Learned stages can't be put in SQL. tests/llm holds run() against the stages' rules applied row by row; that test
#: shares the fitted model, the near-copy links, the tile matcher and the span finder, which have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each result is written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
