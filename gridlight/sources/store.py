"""The sample store: inventories from folder listings, arrays as partitioned Parquet, predictions, runs and specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlight.sources.shared import written

#: The inventory's columns.
SAMPLES = T.StructType([T.StructField(n, k) for n, k in (("sample_id", T.StringType()), ("category", T.StringType()), ("split", T.StringType()), ("defect", T.StringType()), ("label", T.LongType()), ("has_gt", T.BooleanType()), ("file", T.StringType()), ("raw_rgb", T.StringType()), ("raw_xyz", T.StringType()), ("raw_gt", T.StringType()), ("H", T.LongType()), ("W", T.LongType()), ("n_valid", T.LongType()), ("defect_frac", T.DoubleType()))])
#: An accelerator type's document; keys beyond these are errors.
SPECS = "type string, label string, op_support map<string,string>, instances array<struct<name:string,label:string,precisions:map<string,double>,memory_model:string,capacity_mib:double>>"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, split, defect, kind, stem) of files below root/category/split/defect/kind/; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return files.select("path", part(5).alias("category"), part(4).alias("split"), part(3).alias("defect"), part(2).alias("kind"), F.split(part(1), r"\.")[0].alias("stem"))


def categories(files: DataFrame) -> DataFrame:
    return files.select("category").distinct().orderBy("category")


def samples(files: DataFrame) -> DataFrame:
    """One row per colour image with its position map, and its truth mask if there is one."""
    keys = ["category", "split", "defect", "stem"]
    of = lambda kind, name: files.where(F.col("kind") == kind).select(*keys, F.col("path").alias(name))
    rows = of("rgb", "raw_rgb").join(of("xyz", "raw_xyz"), keys, "left").join(of("gt", "raw_gt"), keys, "left")
    return rows.select(sample_id(F.col("category"), F.col("split"), F.col("defect"), F.col("stem").cast("int")).alias("sample_id"), *keys[:3], F.when(F.col("defect") == "good", 0).otherwise(1).cast("long").alias("label"), F.col("raw_gt").isNotNull().alias("has_gt"), "raw_rgb", "raw_xyz", "raw_gt")


def sample_id(category: Column, split: Column, defect: Column, idx: Column) -> Column:
    return F.format_string("%s_%s_%s_%03d", category, split, defect, idx)


def param_key(size: int, neighbours: int, ratio: float) -> str:
    """The recipe's name, such as s256_so20-2p0."""
    return f"s{size}_so{neighbours}-{ratio}".replace(".", "p")


def statistics(scans: DataFrame) -> DataFrame:
    """``scans`` (.., valid, gt arrays) with n_valid and defect_frac, the latter over all pixels."""
    count = lambda c, f: F.size(F.filter(c, f))
    return scans.withColumns({"n_valid": count("valid", lambda v: v).cast("long"), "defect_frac": count("gt", lambda g: g > 0) / F.size("gt")})


def build(scans: DataFrame, path: str, source: str, recipe: str) -> DataFrame:
    """Appends the samples that the store doesn't have yet, by source, recipe and category, and gives what it added."""
    spark = scans.sparkSession
    rows = statistics(scans).withColumns({"source": F.lit(source), "param_key": F.lit(recipe)})
    if exists(spark, path):  # else the first build
        done = load(spark, path).where((F.col("source") == source) & (F.col("param_key") == recipe)).select("sample_id")
        rows = rows.join(done, "sample_id", "left_anti")
    rows = written(rows, "added")
    rows.write.mode("append").partitionBy("source", "param_key", "category").parquet(path)
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def store_scores(scores: DataFrame, path: str, run: str) -> None:
    """Stores a run's scored images (``harness.SCORES``) below path/run=../category=..; a run stored before is replaced as a whole.

    Files of a category are laid out by image, so that a report of some categories reads these alone.
    """
    scores.repartition("category").sortWithinPartitions("category", "vec_id").write.mode("overwrite").partitionBy("category").parquet(f"{path}/run={run}")


def load_scores(spark: SparkSession, path: str, run: str, cats: list[str] | None = None) -> DataFrame:
    """A run's stored scores; the categories' filter prunes partitions. A run that isn't stored is an error."""
    if not exists(spark, f"{path}/run={run}"):
        raise ValueError(f"run {run} has no stored scores")
    found = spark.read.parquet(f"{path}/run={run}")
    return found if cats is None else found.where(F.col("category").isin(cats))


def recomputed(spark: SparkSession, path: str, run: str, draws: int = 1000) -> DataFrame:
    """The report of a run from its stored scores alone."""
    from gridlight.operators import harness

    return harness.report(load_scores(spark, path, run), draws)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def select(store: DataFrame, split: str | None = None, label: int | None = None, cats: list[str] | None = None) -> DataFrame:
    """The conjunction of the given filters; they reach the scan. An empty selection is an error."""
    for column, value in (("split", split), ("label", label)):
        if value is not None:
            store = store.where(F.col(column) == value)
    if cats is not None:
        store = store.where(F.col("category").isin(cats))
    if store.isEmpty():
        raise ValueError(f"no samples of split {split}, label {label}, categories {cats}")
    return store


def channels(scans: DataFrame, names: list[str]) -> DataFrame:
    """``scans`` with x: the channel arrays laid end to end."""
    return scans.withColumn("x", F.concat(*names))


def finite_metrics(metrics: str) -> Column:
    return F.map_filter(metrics, lambda _, v: v.isNotNull() & ~F.isnan(v))


def log_run(runs: DataFrame, path: str) -> None:
    """Appends runs (run_id, run_name, .., metrics map) without their undefined metrics."""
    runs.withColumn("metrics", finite_metrics("metrics")).write.mode("append").parquet(path)


def flat(df: DataFrame, prefix: str = "") -> list[Column]:
    """A column for each leaf of nested structs, under its dotted name."""
    out = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*path, f.name])
            else:
                at = ".".join(f"`{p}`" for p in [*path, f.name])
                out.append(F.col(at).alias(prefix + ".".join([*path, f.name])))

    walk(df.schema, [])
    return out


def specs(spark: SparkSession, path: str) -> DataFrame:
    """Accelerators of JSON documents, one file a type, each with its type's support map; wrong types and unknown keys are errors."""
    read = spark.read.schema(SPECS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    free = spark.read.option("multiLine", True).json(path)
    known = {f.name for f in read.schema.fields}
    inner = {f.name for f in read.schema["instances"].dataType.elementType.fields}
    found = free.schema["instances"].dataType.elementType.fields if "instances" in free.columns else []
    odd = sorted({*free.columns} - known) + sorted({f.name for f in found} - inner)
    if odd:
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    return read.select("type", "op_support", F.inline("instances")).withColumnRenamed("name", "accelerator")
