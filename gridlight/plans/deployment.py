"""Deployment queries over the published footprints and specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.operators import deploy

#: Two builds' operator tables and the notes around them, made up for these queries.
RKNN_LOG = """build started for two graphs
I RKNN: ID  OpType  DataType  Target  Cycles
I RKNN: 0   InputOperator   INT8     CPU  0
I RKNN: 1   DepthwiseConv   INT8     NPU  8810
I RKNN: 2   Add             INT8     NPU  512
I RKNN: 3   Resize          FLOAT16  CPU  77020
I RKNN: 4   OutputOperator  INT8     CPU  0
saved to stem.bin
I RKNN: 7   Gelu            INT8     NPU  3
I RKNN: ID  OpType  DataType  Target  Cycles
I RKNN: memory 12 blocks

I RKNN: 1   Gemm            FLOAT16  NPU  40960
I RKNN: 2   Sqrt            FLOAT16  NPU  128
I RKNN: 3   ArgMax          INT64    CPU  9000"""
EDGETPU_LOG = """compiled in 41 ms
PAD 1 Mapped to Edge TPU
=== stem ===
DEPTHWISE_CONV_2D  6  Mapped to Edge TPU
PAD                2  Mapped to Edge TPU
note: 8 of 8
=== lookup ===
FULLY_CONNECTED    1  Mapped to Edge TPU
ARG_MAX            1  Operation not supported
QUANTIZE           2  Mapped to Edge TPU
=== head ===
GELU               4  Operation not supported
SPLIT              1  More than one subgraph is not supported"""
OBJ = "# a tent\nv -1.5 0 2\nv 1.5 0 2\nv 0 2.25 0\nv 0 0 -2\n\nf 1 2 3\nf 2//1 4//2 3//1"
BANKS = [("patchcore_rgb_bank", 20000, 1536, 1024), ("fpfh_geometry_bank", 122000, 33, 2000), ("anchor", 10000, 256, 1024)]
EXPORTED = [("convvae_xyz", True, ["Conv", "Relu"]), ("draem_rgb", True, ["Conv", "Sigmoid"]), ("backbone_layer2", True, ["Conv"]), ("backbone_layer3", True, ["Conv"]), ("patchcore_rgb_bank", False, None), ("pointmae", True, ["MatMul", "Softmax"])]


def fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.matrix(*deploy.documents(spark))


def fit_matrix_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix's cells as JSON documents, counted by verdict."""
    m = fit_matrix(spark, sf_dir).withColumn("doc", F.to_json(F.struct("detector", "accelerator", "precision", "onnx")))
    return m.groupBy("verdict").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"))


def work_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp, det, _ = deploy.documents(spark)
    return deploy.work_set(comp, det)


def bank_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.bank_cost(spark.createDataFrame(BANKS, "name string, n long, c long, patches long"))


def export_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.export_check(deploy.documents(spark)[1], spark.createDataFrame(EXPORTED, "name string, ok boolean, ops array<string>"))


def rknn_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.parse_rknn(deploy.log_lines(spark, RKNN_LOG), ["stem", "lookup", "head"])


def edgetpu_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.parse_edgetpu(deploy.log_lines(spark, EDGETPU_LOG))


def op_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deploy.op_verdict(edgetpu_parse(spark, sf_dir))


def obj_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = deploy.parse_obj(deploy.log_lines(spark, OBJ))
    return v.select(F.lit("v").alias("kind"), "pos", F.format_string("%.2f %.2f %.2f", "x", "y", "z").alias("value")).unionByName(f.select(F.lit("f").alias("kind"), "pos", F.array_join(F.transform("face", lambda i: i.cast("string")), " ").alias("value")))


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else repr(float(v)) + "e0" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


_COMP = f"comp(name, params_m, gflops, act_mb, fp32, int8) AS (VALUES {_values(deploy.COMPONENTS)})"
_DET = f"det(detector, op_class, pieces) AS (VALUES {_values(deploy.DETECTORS)})"
_ACC = f"acc(accelerator, type, precision, rate, memory_model, cap) AS (VALUES {_values([(a, t, p, r, m, c) for a, t, ps, m, c in deploy.ACCELERATORS for p, r in ps.items()])})"
_SUP = f"sup(type, op_class, support) AS (VALUES {_values([(t, o, s) for t, m in deploy.SUPPORT.items() for o, s in m.items()])})"
_WORK = f"""{_COMP}, {_DET}, pc AS (SELECT detector, op_class, unnest(pieces) AS name FROM det),
work AS (SELECT detector, op_class, precision, round(sum(gflops), 2) AS gflops, round(sum(CASE precision WHEN 'int8' THEN int8 WHEN 'fp16' THEN fp32 * 0.5e0 ELSE fp32 END * (1e6 / 1048576)) + max(act_mb * (1e6 / 1048576)), 2) AS work_mib FROM pc JOIN comp USING (name), (VALUES ('fp32'), ('fp16'), ('int8')) p(precision) GROUP BY 1, 2, 3)"""
_MATRIX = f"""{_WORK}, {_ACC}, {_SUP},
cell AS (SELECT *, gflops / 1e3 / (rate * 0.7e0) * 1e3 AS lo, gflops / 1e3 / (rate * 0.3e0) * 1e3 AS hi, support = 'unsupported' AS g1, NOT onnx AND type IN ('npu_fixed', 'npu_soc') AS g2, support = 'host_tail' AS g3, coalesce(work_mib > cap AND memory_model = 'on_die_only', false) AS g4, coalesce(work_mib > cap, false) AS g5 FROM work JOIN acc USING (precision) JOIN sup USING (type, op_class), (VALUES (true), (false)) o(onnx)),
m AS (SELECT detector, accelerator, precision, onnx, support AS op_support, gflops, work_mib, CASE WHEN g1 OR g2 THEN 'does-not-deploy' WHEN g3 THEN 'backbone+host-tail' WHEN g4 THEN 'does-not-deploy' WHEN g5 THEN 'streams-offchip' ELSE 'full-ondevice' END AS verdict, CASE WHEN g1 THEN 'operator class not supported' WHEN g2 THEN 'no compiled graph' WHEN g3 THEN 'selection runs on the host' WHEN g4 THEN 'over the on-die memory' WHEN g5 THEN 'over the memory, streamed' ELSE 'fits' END AS reason, round(lo, 2) AS ms_lo, round(hi, 2) AS ms_hi, round(1e3 / hi, 1) AS fps_lo, round(1e3 / lo, 1) AS fps_hi FROM cell)"""


def _lines(text: str) -> str:
    return "l AS (SELECT i - 1 AS pos, t[i] AS line FROM (SELECT string_split('" + text.replace("'", "''") + "', chr(10)) AS t), range(1, 100) r(i) WHERE i <= len(t))"


_EDGE = f"{_lines(EDGETPU_LOG)}, h AS (SELECT pos, line, regexp_split_to_array(trim(line), '\\s+') AS w, last_value(CASE WHEN line[1] = '=' THEN nullif(trim(replace(line, '=', ' ')), '') END IGNORE NULLS) OVER (ORDER BY pos) AS graph FROM l), e AS (SELECT graph, CAST(pos AS INT) AS pos, w[1] AS op, CAST(w[2] AS BIGINT) AS n, CASE WHEN contains(line, '{deploy.MAPPED}') THEN 'EDGETPU' ELSE 'CPU' END AS target FROM h WHERE graph IS NOT NULL AND len(w) > 2 AND w[1] = upper(w[1]) AND w[1][1] BETWEEN 'A' AND 'Z' AND try_cast(w[2] AS BIGINT) >= 0)"

QUERIES = {f.__name__: f for f in (fit_matrix, fit_matrix_json, work_set, bank_cost, export_check, rknn_parse, edgetpu_parse, op_verdict, obj_parse)}
ORACLES = {
    "fit_matrix": f"WITH {_MATRIX} SELECT * FROM m",
    "fit_matrix_json": f"WITH {_MATRIX} SELECT verdict, count(*) AS n, min('{{\"detector\":\"' || detector || '\",\"accelerator\":\"' || accelerator || '\",\"precision\":\"' || precision || '\",\"onnx\":' || CAST(onnx AS VARCHAR) || '}}') AS first_doc FROM m GROUP BY 1",
    "work_set": f"WITH {_WORK} SELECT detector, op_class, precision, gflops, work_mib FROM work",
    "bank_cost": f"SELECT name, round(n * c / 1e6, 2) AS params_m, round(2 * p * n * c / 1e9, 2) AS gflops, round(n * c * 4 / 1e6, 2) AS disk_fp32_mb, round((n * 8 + 8 * 256 * (c // 8) * 4) / 1e6, 2) AS disk_int8_mb FROM (SELECT name, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS c, CAST(p AS BIGINT) AS p FROM (VALUES {_values(BANKS)}) b(name, n, c, p))",
    "export_check": f"WITH {_DET}, ex(name, ok, ops) AS (VALUES {_values(EXPORTED)}), g AS (SELECT detector, op_class, coalesce(bool_and(ok), true) AS pe, coalesce(bool_or(list_contains(ops, 'Softmax')), false) AS ha FROM (SELECT detector, op_class, unnest(pieces) AS name FROM det) LEFT JOIN ex USING (name) GROUP BY 1, 2) SELECT detector, pe AS pieces_exported, ha AS has_attention, CASE WHEN pe THEN ha = (op_class = 'transformer_attention') ELSE op_class <> 'transformer_attention' END AS corroborated FROM g",
    "rknn_parse": f"WITH {_lines(RKNN_LOG)}, a AS (SELECT pos, line, regexp_split_to_array(trim(line), '\\s+') AS w FROM l), b AS (SELECT *, list_has_all(w, ['ID', 'OpType', 'Target']) AS hd, list_position(list_transform(w, lambda x: try_cast(x AS BIGINT) IS NOT NULL), true) AS i FROM a), c AS (SELECT *, coalesce(w[i + 2] IN ('FLOAT16', 'INT64', 'INT8', 'BOOL', 'FLOAT') AND w[i + 3] IN ('NPU', 'CPU'), false) AS rw, sum(CAST(hd AS INT)) OVER (ORDER BY pos) AS tb FROM b), d AS (SELECT *, sum(CAST(NOT hd AND NOT rw AND trim(line) <> '' AND NOT contains(line, 'RKNN:') AS INT)) OVER (PARTITION BY tb ORDER BY pos) AS en FROM c) SELECT CASE tb WHEN 1 THEN 'stem' ELSE 'lookup' END AS graph, CAST(pos AS INT) AS pos, w[i + 1] AS op, w[i + 3] AS target FROM d WHERE tb > 0 AND en = 0 AND rw AND w[i + 1] NOT IN ('InputOperator', 'OutputOperator')",
    "edgetpu_parse": f"WITH {_EDGE} SELECT * FROM e",
    "op_verdict": f"WITH {_EDGE} SELECT graph, CASE WHEN bool_and(target <> 'CPU') THEN 'native' WHEN bool_or(op IN ('TOPK_V2', 'ARG_MIN', 'ARG_MAX')) AND bool_and(target <> 'CPU' OR op IN ('TOPK_V2', 'ARG_MIN', 'ARG_MAX', 'QUANTIZE', 'DEQUANTIZE', 'TRANSPOSE', 'NEG')) THEN 'host_tail' ELSE 'host_fragmented(' || substring(string_agg(DISTINCT op, ',' ORDER BY op) FILTER (WHERE target = 'CPU'), 1, 60) || ')' END AS verdict FROM e GROUP BY 1",
    "obj_parse": f"WITH {_lines(OBJ)}, p AS (SELECT CAST(pos AS INT) AS pos, string_split(line, ' ') AS p FROM l) SELECT 'v' AS kind, pos, printf('%.2f %.2f %.2f', CAST(p[2] AS DOUBLE), CAST(p[3] AS DOUBLE), CAST(p[4] AS DOUBLE)) AS value FROM p WHERE p[1] = 'v' UNION ALL SELECT 'f', pos, array_to_string(list_transform(p[2:4], lambda t: CAST(CAST(string_split(t, '/')[1] AS INT) - 1 AS VARCHAR)), ' ') FROM p WHERE p[1] = 'f'",
}
