"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder in local mode (as in tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: For tables whose rows are MBs: readers and writers hold a row group, and Parquet looks at its size, compressed, after 100 rows.
LARGE_ROWS = {"parquet.block.row.count.limit": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it is computed once, and lost executors lose none of it. ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_sent(df: DataFrame) -> DataFrame:
    """``df`` for a join that doesn't broadcast it by a guess: an exploded table is guessed to be as large as its rows before, and a written one as its packed files."""
    return df.hint("merge")


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped beside a table that it was made of."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
