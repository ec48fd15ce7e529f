"""The corpus pipeline: documents cleaned in five stages, each one of the training-data operators.

Every stage gets what its predecessor kept, written as Parquet and read again, so a stage that fails
or loses executors starts from a table and not from the beginning.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlight.llm import bpe, decontaminate, near_duplicates, pseudonyms, toxicity
from gridlight.llm.common import shared_dir, table


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of each document's ids and decoded bytes."""
    return bpe.round_trip(docs, bpe.rank_spec())


#: (name, function of (spark, docs, sf_dir)); all but the last keep the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", pseudonyms.stage),
    ("byte_bpe", encoded),
]

#: The stages learn, search and permute; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each result but the last is written to the shared folder and read again."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
