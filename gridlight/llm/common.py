"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.operators.graph import components
from gridlight.sources.shared import LARGE_ROWS, never_sent, shared_dir, written

__all__ = ["LARGE_ROWS", "SPACE", "components", "give_back", "held_out", "never_sent", "one_thread", "shared_dir", "table", "written"]

#: The white space that ends a word; bytes.split() without arguments splits on the same six bytes.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(remainder: int, id_col: str = "doc_id"):
    """Whether crc32(id as text) mod 5 is ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == remainder


def one_thread() -> None:
    """Keeps the tokenizers library to the task's own thread: a pool of one thread a core in every worker holds memory of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks and wait beside the JVM's later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass
