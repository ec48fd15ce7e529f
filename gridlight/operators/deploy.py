"""Deployment fit: detectors crossed with accelerator specifications, and checks of compiler logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Published footprints (million parameters, GFLOPs, activation MB, fp32 MB, int8 MB).
COMPONENTS = [
    ("convvae_xyz", 30.78, 2.3, 15.7, 123.11, 30.78),
    ("draem_rgb", 15.53, 48.41, 76.9, 62.13, 15.53),
    ("backbone_layer2", 4.13, 12.99, 19.9, 16.51, 4.13),
    ("backbone_layer3", 24.86, 24.0, 23.6, 99.45, 24.86),
    ("feat_ae", 2.05, 0.89, 8.7, 8.2, 2.05),
    ("pointmae", 21.83, 191.88, 810.1, 87.3, 21.83),
    ("patchcore_rgb_bank", 30.72, 62.91, 0.0, 122.88, 1.73),
    ("fpfh_geometry_bank", 4.03, 16.1, 0.0, 16.1, 1.01),
]
#: The detectors, their class of operators and their pieces.
DETECTORS = [
    ("convvae", "conv_native", ["convvae_xyz"]),
    ("draem", "conv_native", ["draem_rgb"]),
    ("feat_recon", "conv_native", ["backbone_layer2", "feat_ae"]),
    ("patchcore", "bank_lookup", ["backbone_layer3", "patchcore_rgb_bank"]),
    ("btf", "bank_lookup", ["fpfh_geometry_bank"]),
    ("fused", "bank_lookup", ["backbone_layer3", "patchcore_rgb_bank", "fpfh_geometry_bank"]),
    ("pointmae", "transformer_attention", ["pointmae"]),
]
#: Accelerators with their peak TOPS by precision, memory model and capacity (MiB; null if unknown).
ACCELERATORS = [
    ("rpi5_cortex_a76", "cpu", {"fp32": 0.15, "int8": 0.61}, "system", 8192.0),
    ("jetson_orin_nx", "gpu", {"fp16": 25.0, "int8": 50.0}, "unified", None),
    ("coral_edgetpu", "npu_fixed", {"int8": 4.0}, "scratchpad_host", 8.0),
    ("hailo_8", "npu_fixed", {"int8": 26.0}, "on_die_only", None),
    ("hailo_8l", "npu_fixed", {"int8": 13.0}, "on_die_only", None),
    ("rknn_rk3588", "npu_soc", {"int8": 6.0}, "unified", None),
]
#: How a type of accelerator supports each class of operators.
SUPPORT = {
    "cpu": {"conv_native": "native", "bank_lookup": "native", "transformer_attention": "native"},
    "gpu": {"conv_native": "native", "bank_lookup": "native", "transformer_attention": "native"},
    "npu_fixed": {"conv_native": "native", "bank_lookup": "host_tail", "transformer_attention": "unsupported"},
    "npu_soc": {"conv_native": "native", "bank_lookup": "host_tail", "transformer_attention": "unsupported"},
}
MIB = 1e6 / 1024**2
#: Sustained shares of the peak rate that bound the latency.
EFFICIENCY = (0.30, 0.70)


def documents(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, detectors, accelerators) as tables; an accelerator inherits its type's support map."""
    comp = spark.createDataFrame(COMPONENTS, "name string, params_m double, gflops double, act_mb double, disk_fp32_mb double, disk_int8_mb double")
    det = spark.createDataFrame(DETECTORS, "detector string, op_class string, pieces array<string>")
    acc = spark.createDataFrame([(*a, SUPPORT[a[1]]) for a in ACCELERATORS], "accelerator string, type string, precisions map<string,double>, memory_model string, capacity_mib double, op_support map<string,string>")
    return comp, det, acc


def work_set(components: DataFrame, detectors: DataFrame) -> DataFrame:
    """(detector, op_class, precision, gflops, work_mib): summed compute and weights of the pieces, plus the largest activation."""
    weight = F.when(F.col("precision") == "int8", F.col("disk_int8_mb")).otherwise(F.col("disk_fp32_mb") * F.when(F.col("precision") == "fp16", 0.5).otherwise(1.0)) * MIB
    pieces = detectors.select("detector", "op_class", F.explode("pieces").alias("name")).join(F.broadcast(components), "name")
    each = pieces.withColumn("precision", F.explode(F.array(*map(F.lit, ("fp32", "fp16", "int8")))))
    return each.groupBy("detector", "op_class", "precision").agg(F.round(F.sum("gflops"), 2).alias("gflops"), F.round(F.sum(weight) + F.max(F.col("act_mb") * MIB), 2).alias("work_mib"))


def matrix(components: DataFrame, detectors: DataFrame, accelerators: DataFrame) -> DataFrame:
    """One cell per detector, accelerator, precision of that accelerator and export option, with verdict, reason and latency band.

    Gates are tried in order: operators that aren't supported, a missing compiled graph, a host tail,
    then memory; an unknown capacity fits.
    """
    cells = accelerators.withColumn("precision", F.explode(F.map_keys("precisions"))).withColumn("onnx", F.explode(F.array(F.lit(True), F.lit(False))))
    cells = work_set(components, detectors).join(F.broadcast(cells), "precision")
    support = F.element_at("op_support", F.col("op_class"))
    npu = F.col("type").isin("npu_fixed", "npu_soc")
    over = F.col("work_mib") > F.col("capacity_mib")
    gates = [
        (support == "unsupported", "does-not-deploy", "operator class not supported"),
        (~F.col("onnx") & npu, "does-not-deploy", "no compiled graph"),
        (support == "host_tail", "backbone+host-tail", "selection runs on the host"),
        (over & (F.col("memory_model") == "on_die_only"), "does-not-deploy", "over the on-die memory"),
        (over, "streams-offchip", "over the memory, streamed"),
    ]
    pick = lambda k, rest: F.coalesce(*(F.when(g[0], F.lit(g[k])) for g in gates), F.lit(rest))
    rate = F.element_at("precisions", F.col("precision"))
    fast, slow = (F.col("gflops") / 1e3 / (rate * e) * 1e3 for e in reversed(EFFICIENCY))
    return cells.select("detector", "accelerator", "precision", "onnx", support.alias("op_support"), "gflops", "work_mib", pick(1, "full-ondevice").alias("verdict"), pick(2, "fits").alias("reason"), F.round(fast, 2).alias("ms_lo"), F.round(slow, 2).alias("ms_hi"), F.round(1e3 / slow, 1).alias("fps_lo"), F.round(1e3 / fast, 1).alias("fps_hi"))


def bank_cost(banks: DataFrame, m: int = 8, bits: int = 8) -> DataFrame:
    """Footprint of banks (name, n, c, patches): parameters, distance product, raw store, and product-quantised store with its codebooks."""
    n, c = F.col("n").cast("long"), F.col("c").cast("long")
    pq = n * m + m * 2**bits * F.expr(f"c div {m}") * 4
    return banks.select("name", F.round(n * c / 1e6, 2).alias("params_m"), F.round(2 * F.col("patches") * n * c / 1e9, 2).alias("gflops"), F.round(n * c * 4 / 1e6, 2).alias("disk_fp32_mb"), F.round(pq / 1e6, 2).alias("disk_int8_mb"))


def available(detectors: DataFrame, have: DataFrame) -> DataFrame:
    """(detector) of those all of whose pieces are in ``have`` (name)."""
    rows = detectors.select("detector", F.explode("pieces").alias("name")).join(have.select("name", F.lit(True).alias("there")), "name", "left")
    return rows.groupBy("detector").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all")).where("all").select("detector")


def export_check(detectors: DataFrame, exported: DataFrame) -> DataFrame:
    """(detector, pieces_exported, has_attention, corroborated): does the operators' inventory of the pieces fit the declared class?

    ``exported`` has name, ok and ops; pieces that aren't in it are left out, and none at all count as exported.
    """
    rows = detectors.select("detector", "op_class", F.explode("pieces").alias("name")).join(exported, "name", "left")
    attention = F.array_contains("ops", "Softmax")
    got = rows.groupBy("detector", "op_class").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("pieces_exported"), F.coalesce(F.bool_or(attention), F.lit(False)).alias("has_attention"))
    expected = F.col("op_class") == "transformer_attention"
    return got.select("detector", "pieces_exported", "has_attention", F.when(F.col("pieces_exported"), F.col("has_attention") == expected).otherwise(~expected).alias("corroborated"))


def log_lines(spark: SparkSession, text: str) -> DataFrame:
    """(pos, line) of one log, which is small."""
    return spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", "\n")).alias("pos", "line"))


#: Fixed values of the two compilers' logs: columns of a table's header, data types and targets of its rows, operators that only
#: feed a graph; the status of a mapped operator.
COLUMNS, TYPES, TARGETS, ENDS = ("ID", "OpType", "Target"), ("FLOAT16", "INT64", "INT8", "BOOL", "FLOAT"), ("NPU", "CPU"), ("InputOperator", "OutputOperator")
MAPPED = "Mapped to Edge TPU"
#: Operators that select from a bank, and that only change a layout or a sign.
SELECT = ("TopK", "ArgMin", "ArgMax", "TOPK_V2", "ARG_MIN", "ARG_MAX")
LAYOUT = ("Reshape", "TRANSPOSE", "QUANTIZE", "DEQUANTIZE", "Neg", "NEG")


def parse_rknn(lines: DataFrame, names: list[str]) -> DataFrame:
    """(graph, pos, op, target) of operator tables: a header begins one, the first foreign line ends it; graphs are named in order.

    Lines are cut into words. A row is a number, an operator, a data type and a target in a row; other lines of
    the compiler and empty ones don't end a table. Running sums mark the table and whether it has ended. The window has one partition because a log is one.
    """
    w, words = Window.partitionBy(F.lit(1)).orderBy("pos"), F.split(F.trim("line"), r"\s+")
    t = lines.withColumn("words", words).withColumn("at", F.array_position(F.transform("words", lambda x: x.rlike("^[0-9]+$")), True).cast("int"))
    word = lambda k: F.get("words", F.col("at") - 1 + k)
    is_row = F.coalesce((F.col("at") > 0) & word(2).isin(*TYPES) & word(3).isin(*TARGETS), F.lit(False))
    header = F.forall(F.array(*map(F.lit, COLUMNS)), lambda c: F.array_contains("words", c))
    foreign = ~header & ~is_row & (F.trim("line") != "") & ~F.exists("words", lambda x: x.endswith("RKNN:"))
    t = t.withColumns({"table": F.sum(header.cast("int")).over(w), "row": is_row, "foreign": foreign.cast("int"), "op": word(1), "target": word(3)})
    t = t.withColumn("ended", F.sum("foreign").over(Window.partitionBy("table").orderBy("pos")))
    kept = t.where("table > 0 and ended = 0 and row").where(~F.col("op").isin(*ENDS))
    kept = kept.withColumn("k", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("table")))
    return kept.select(F.get(F.array(*map(F.lit, names)), (F.col("k") - 1).cast("int")).alias("graph"), "pos", "op", "target").where("graph is not null")


def parse_edgetpu(lines: DataFrame) -> DataFrame:
    """(graph, pos, op, n, target) of operator tables under headlines (a name between rulers), which carry down.

    A row is an operator in capitals, a count and a status.
    """
    w, words = Window.partitionBy(F.lit(1)).orderBy("pos"), F.split(F.trim("line"), r"\s+")
    name = F.when(F.startswith("line", F.lit("=")), F.trim(F.translate("line", "=", " ")))
    t = lines.withColumns({"words": words, "graph": F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(w)})
    word = lambda k: F.get("words", F.lit(k))
    is_row = (F.size("words") > 2) & (word(0) == F.upper(word(0))) & word(0).rlike("^[A-Z]") & word(1).rlike("^[0-9]+$")
    target = F.when(F.contains("line", F.lit(MAPPED)), "EDGETPU").otherwise("CPU")
    return t.where(F.col("graph").isNotNull() & is_row).select("graph", "pos", word(0).alias("op"), word(1).cast("long").alias("n"), target.alias("target"))


def op_verdict(ops: DataFrame) -> DataFrame:
    """(graph, verdict) of compiled operators: native, host_tail if only the selection and reshaping are on the host, else the host's operators."""
    host: Column = ~F.col("target").isin("NPU", "EDGETPU")
    g = ops.groupBy("graph").agg(F.array_sort(F.collect_set(F.when(host, F.col("op")))).alias("host"), F.bool_or(F.col("op").isin(*SELECT)).alias("tail"), F.bool_and(~host | F.col("op").isin(*SELECT, *LAYOUT)).alias("rest"))
    return g.select("graph", F.when(F.size("host") == 0, "native").when(F.col("tail") & F.col("rest"), "host_tail").otherwise(F.concat(F.lit("host_fragmented("), F.substring(F.array_join("host", ","), 1, 60), F.lit(")"))).alias("verdict"))


def parse_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of mesh text lines (pos, line): vertices as numbers, faces as vertex numbers from 0."""
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\s+"))
    verts = parts.where("p[0] = 'v'").select("pos", *(F.get("p", F.lit(i)).cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))))
    faces = parts.where("p[0] = 'f'").select("pos", F.transform(F.slice("p", 2, 3), lambda t: F.split(t, "/")[0].cast("int") - 1).alias("face"))
    return verts, faces
