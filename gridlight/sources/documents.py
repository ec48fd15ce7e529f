"""Documents without a fixed schema: parameters of runs, properties of events, as rows of dotted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.sources.shared import written


def flat_documents(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, value) for every value of the JSON documents in ``column`` that isn't itself an object, under its dotted key.

    Documents are parsed once to VARIANT; each level of nesting is one pass over the objects that are left, without
    shuffles, so keys needn't be known and depth isn't bounded. Numbers, texts and truth values are given as text, lists as JSON,
    JSON's null as null. Empty objects, null and malformed documents, and documents that are no objects give no rows; a key
    that is spelled both with a dot and by nesting gives a row for each. Rows with equal keys stay apart documents, each with its rows.
    ``store.flat`` is the counterpart for structs.
    """
    is_object = F.schema_of_variant("_doc").startswith("OBJECT")
    level = df.select(*(F.col(k) for k in keys), F.lit("").alias("path"), F.try_parse_json(column).alias("_doc")).where(is_object)
    found = None
    while True:
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("_doc").outer()).select(F.col("key"), F.col("value")))
        inner = inner.select(*keys, F.concat("path", "key").alias("path"), F.col("value").alias("_doc"))
        inner = written(inner, "values")
        leaves = inner.where(~F.coalesce(is_object, F.lit(False))).select(*keys, "path", F.col("_doc").cast("string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        level = inner.where(is_object).withColumn("path", F.concat("path", F.lit(".")))
        if level.isEmpty():
            return found
