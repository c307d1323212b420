"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, secrets
and the mix of sources, one operator of ``graphweft.llm`` after the other.

Each stage takes (spark, docs, sf_dir) and gives what it keeps of ``docs``; its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import decontaminate, langid, minhash, mixing, secrets
from graphweft.session import scratch_path

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("source_mix", mixing.stage),
]

#: the models and iterations of the stages have no SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
