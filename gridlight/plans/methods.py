"""Method pipelines and the smaller selections, masks and set operations around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.functions import ranking
from gridlight.operators import bank, deploy, grid, tracking
from gridlight.plans.banks import _D, _E, _vectors
from gridlight.plans.deployment import _DET, _values, EXPORTED
from gridlight.plans.grids import _NORMALS, PIXELS_SQL, scans, surface
from gridlight.plans.inventory import _SAMPLES, runs, samples
from gridlight.plans.metrics import auroc_sql
from gridlight.sources import store
from gridlight.sources.tables import table


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pixels and the share of defect pixels of each image, within its row."""
    s = scans(spark, sf_dir).withColumn("gt", F.transform("mask", lambda m: m.cast("int")))
    return store.statistics(s).select("vec_id", "n_valid", F.round("defect_frac", 9).alias("defect_frac"))


def facing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an image's normals face the viewer."""
    n = grid.normals(surface(spark, sf_dir))
    return n.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum((F.abs(F.round("nz", 6)) > 0.3).cast("long")).alias("facing"))


def eroded_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pixels before and after an erosion by one pixel (all four neighbours valid, none beyond the border)."""
    s = grid.eroded(scans(spark, sf_dir))
    count = lambda c: F.size(F.filter(c, lambda v: v)).cast("long")
    return s.select("vec_id", count("valid").alias("n_valid"), count("eroded").alias("n_eroded"))


def random_tile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 tiles kept or masked by a fixed draw of their image and place: pixels kept and their summed score."""
    tile = F.expr("(pix div 32) * 2 + (pix % 8) div 4").cast("long")
    kept = (F.col("vec_id") * 7919 + tile * 104729 + 12345) * 48271 % 1000003 / F.lit(1000003.0) >= 0.5
    s = surface(spark, sf_dir).withColumn("kept", kept)
    return s.groupBy("vec_id").agg(F.sum(F.col("kept").cast("long")).alias("n_kept"), F.round(F.sum(F.when(F.col("kept"), F.col("amap")).otherwise(0.0)) + 0.0, 6).alias("total"))


def export_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 16 valid pixels of each image for display, the first of a fixed pseudo-random order."""
    order = (F.col("pix") * 48271 + F.col("vec_id") * 7919) % 1000003
    k = F.row_number().over(Window.partitionBy("vec_id").orderBy(order, "pix"))
    s = surface(spark, sf_dir).where("valid").withColumn("k", k).where("k <= 16")
    return s.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.col("pix").cast("long")).alias("pixels"), F.round(F.sum("z"), 6).alias("depth"))


def bank_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the bank put back on the whole grid of vectors: 0 for those that weren't scored."""
    e = _vectors(spark, sf_dir)
    scored = bank.nearest(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0")).select("vec_id", "dist")
    return e.select("vec_id").join(scored, "vec_id", "left").select("vec_id", F.round(F.coalesce("dist", F.lit(0.0)), 8).alias("dist"))


def bank_method_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank method from fit to report: even vectors are the bank, distances of the odd ones are scores, ranked by group of categories."""
    e = _vectors(spark, sf_dir)
    scored = bank.nearest(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0")).select("vec_id", F.round("dist", 8).alias("score"))
    s = scored.join(e.select("vec_id", "category"), "vec_id").select(F.expr("category div 2").alias("grp"), (F.col("category") % 2).cast("int").alias("label"), "score")
    return ranking.auroc(s, ["grp"]).select("grp", "n", "n_pos", F.round("auroc", 9).alias("auroc"))


def triad_gap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap of the second arm to the first, and closure, what the third is above the second: macro means over names."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("arm"), F.col("o_totalprice").alias("m"))
    m = tracking.pivot_arms(o, "name", "arm", "m", ["F", "O", "P"], "F").agg(*(F.avg(a).alias(a) for a in "FOP"))
    return m.select(F.round(F.col("F") - F.col("O"), 4).alias("gap"), F.round(F.col("P") - F.col("O"), 4).alias("closure"))


def latest_with_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each name, over all experiments, that carries the metric."""
    carrying = runs(spark, sf_dir).where("metric > 100000")
    return tracking.latest(carrying).select("run_name", "run_id", "experiment")


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and synthetic samples in one table with their source."""
    s = samples(spark, sf_dir).select("category", "label")
    real, synth = (s.where(F.col("label") == k).withColumn("source", F.lit(n)) for k, n in ((0, "real"), (1, "synth")))
    return real.unionByName(synth).groupBy("source", "category").agg(F.count("*").alias("n"))


def sample_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample specifications category:split:defect:number taken apart."""
    spec = samples(spark, sf_dir).select(F.concat_ws(":", "category", "split", "defect", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("spec"))
    p = F.split("spec", ":")
    return spec.select(p[0].alias("category"), p[1].alias("split"), p[2].alias("defect"), p[3].cast("long").alias("idx"))


def payload_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags such as p150 of payloads, rounded half to even."""
    x = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.bround(F.col("l_quantity") / 8 * 100).cast("int").cast("string")).alias("tag"))
    return x.groupBy("tag").agg(F.count("*").alias("n"))


def detector_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors all of whose pieces were exported."""
    det = deploy.documents(spark)[1]
    have = spark.createDataFrame([(n,) for n, *_ in EXPORTED], "name string")
    return deploy.available(det, have)


def op_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each export's operators, those of attention among them, and those that aren't convolution's."""
    e = spark.createDataFrame(EXPORTED, "name string, ok boolean, ops array<string>").select("name", F.coalesce("ops", F.array().cast("array<string>")).alias("ops"))
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    fixed = lambda *x: F.array(*map(F.lit, x))
    return e.select("name", said(F.col("ops")).alias("ops"), said(F.array_intersect("ops", fixed("Softmax"))).alias("attention"), said(F.array_except("ops", fixed("Conv", "Relu"))).alias("other"))


_EX = f"ex(name, ok, ops) AS (VALUES {_values(EXPORTED)})"
_NEAR = f"{_E}, d AS (SELECT q.vec_id, q.category, min({_D}) AS dist FROM e q, e b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (store_statistics, facing_points, eroded_mask, random_tile_mask, export_downsample, bank_scatter, bank_method_auroc, triad_gap_closure, latest_with_metric, union_sources, sample_spec, payload_tag, detector_availability, op_sets)}
ORACLES = {
    "store_statistics": f"SELECT vec_id, count(*) FILTER (WHERE valid) AS n_valid, round(avg(CAST(mask AS INT)), 9) AS defect_frac FROM ({PIXELS_SQL}) GROUP BY 1",
    "facing_points": f"SELECT vec_id, count(*) AS n, CAST(sum(CAST(abs(nz) > 0.3e0 AS INT)) AS BIGINT) AS facing FROM ({_NORMALS}) GROUP BY 1",
    "eroded_mask": f"WITH p AS ({PIXELS_SQL}) SELECT a.vec_id, count(DISTINCT a.pix) AS n_valid, count(b.pix) FILTER (WHERE b.n = 4) AS n_eroded FROM p a LEFT JOIN (SELECT x.vec_id, x.pix, count(*) AS n FROM p x JOIN p y ON x.vec_id = y.vec_id AND abs(x.v - y.v) + abs(x.u - y.u) = 1 WHERE y.valid GROUP BY 1, 2) b ON a.vec_id = b.vec_id AND a.pix = b.pix WHERE a.valid GROUP BY 1",
    "random_tile_mask": f"SELECT vec_id, CAST(sum(CAST(k AS INT)) AS BIGINT) AS n_kept, round(sum(CASE WHEN k THEN amap ELSE 0 END) + 0.0, 6) AS total FROM (SELECT vec_id, amap, (vec_id * 7919 + (pix // 32 * 2 + pix % 8 // 4) * 104729 + 12345) * 48271 % 1000003 / 1000003e0 >= 0.5 AS k FROM ({PIXELS_SQL})) GROUP BY 1",
    "export_downsample": f"SELECT vec_id, count(*) AS n, CAST(sum(pix) AS BIGINT) AS pixels, round(sum(amap + 2), 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (pix * 48271 + vec_id * 7919) % 1000003, pix) AS k FROM ({PIXELS_SQL}) WHERE valid) WHERE k <= 16 GROUP BY 1",
    "bank_scatter": f"WITH {_NEAR} SELECT e.vec_id, round(coalesce(dist, 0), 8) AS dist FROM e LEFT JOIN d USING (vec_id)",
    "bank_method_auroc": f"WITH {_NEAR} SELECT grp, n, n_pos, round(auroc, 9) AS auroc FROM ({auroc_sql('SELECT category // 2 AS grp, CAST(category % 2 AS INT) AS label, round(dist, 8) AS score FROM d', 'grp')})",
    "triad_gap_closure": "SELECT round(f - o, 4) AS gap, round(p - o, 4) AS closure FROM (SELECT avg(f) AS f, avg(o) AS o, avg(p) AS p FROM (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority))",
    "latest_with_metric": "SELECT o_custkey AS run_name, o_orderkey AS run_id, o_orderpriority AS experiment FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_totalprice > 100000) WHERE k = 1",
    "union_sources": f"WITH {_SAMPLES} SELECT CASE WHEN label = 0 THEN 'real' ELSE 'synth' END AS source, category, count(*) AS n FROM i GROUP BY 1, 2",
    "sample_spec": f"WITH {_SAMPLES} SELECT category, split, defect, doc_id AS idx FROM i",
    "payload_tag": "SELECT 'p' || CAST(round_even(l_quantity / 8 * 100, 0) AS INT) AS tag, count(*) AS n FROM lineitem GROUP BY 1",
    "detector_availability": f"WITH {_DET}, {_EX} SELECT detector FROM (SELECT detector, unnest(pieces) AS name FROM det) LEFT JOIN ex USING (name) GROUP BY 1 HAVING bool_and(ok IS NOT NULL)",
    "op_sets": f"WITH {_EX} SELECT name, coalesce(array_to_string(list_sort(list_distinct(ops)), ','), '') AS ops, coalesce(array_to_string(list_sort(list_intersect(ops, ['Softmax'])), ','), '') AS attention, coalesce(array_to_string(list_sort(list_filter(ops, lambda x: x NOT IN ('Conv', 'Relu'))), ','), '') AS other FROM ex",
}
