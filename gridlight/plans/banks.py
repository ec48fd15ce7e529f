"""Feature-bank and point-cloud queries: even vectors are the bank, odd ones the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.operators import bank
from gridlight.plans.grids import PIXELS_SQL, scans
from gridlight.sources.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("category"))


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in space: the first three components."""
    e = _vectors(spark, sf_dir)
    return e.select("vec_id", "category", *(F.col("embedding")[i].alias(c) for i, c in enumerate("xyz"))).withColumn("embedding", F.array("x", "y", "z"))


def bank_nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return bank.nearest(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0")).select("vec_id", "bank_id", F.round("dist", 8).alias("dist"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return bank.nearest(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), 5).select("vec_id", "rank", "bank_id", F.round("dist", 8).alias("dist"))


def bank_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and bias that turn distance scoring into one linear layer: -2b and |b|^2, here as their sums."""
    e = _vectors(spark, sf_dir).where("vec_id % 2 = 0")
    add = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    return e.select("vec_id", F.round(add("embedding", lambda x: -2 * x), 8).alias("weight_sum"), F.round(add("embedding", lambda x: x * x), 8).alias("bias"))


def fps_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.farthest_points(_cloud(spark, sf_dir), ["category"], 8)


def greedy_coreset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy k-centre over the full vectors of each category."""
    return bank.farthest_points(_vectors(spark, sf_dir), ["category"], 5)


def sor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.outlier_filter(_cloud(spark, sf_dir), 20, 2.0).select("vec_id", F.round("mean_dist", 8).alias("mean_dist"), "kept")


def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.voxel_downsample(_cloud(spark, sf_dir), 0.1).select("vx", "vy", "vz", "n", *(F.round(F.col(c) + 0.0, 7).alias(c) for c in "xyz"))


def mahalanobis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cloud(spark, sf_dir)
    return bank.mahalanobis(c.where("vec_id % 2 = 0"), c.where("vec_id % 2 = 1"), "vec_id", ["x", "y"]).select("vec_id", F.round("dist", 7).alias("dist"))


def masked_zscore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score maps fused with weight 0.7: the map and its mirror image, summed up by image."""
    s = scans(spark, sf_dir)
    pixels = s.select("vec_id", "category", F.explode(F.arrays_zip("amap", F.reverse("amap").alias("other"), "valid")).alias("p")).select("vec_id", "category", F.col("p.amap").alias("one"), F.col("p.other").alias("two"), F.col("p.valid").alias("valid"))
    return bank.fuse(pixels, "one", "two", 0.7).groupBy("vec_id").agg(F.round(F.sum("fused") + 0.0, 6).alias("total"), F.round(F.max("fused"), 6).alias("peak"))


def unit_sphere_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds of each category centred and scaled by their largest radius."""
    w = Window.partitionBy("category")
    c = _cloud(spark, sf_dir).withColumns({f"c{a}": F.col(a) - F.avg(a).over(w) for a in "xyz"})
    r = F.sqrt(sum((F.col(f"c{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    c = c.withColumn("r", r).withColumn("top", F.max("r").over(w) + 1e-6)
    return c.select("vec_id", F.round(F.col("r") / F.col("top"), 7).alias("radius"))


def nearest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's nearest group centre among the farthest-point picks of its category."""
    c = _cloud(spark, sf_dir)
    centres = bank.farthest_points(c, ["category"], 4).select("category", F.col("point").alias("centre")).join(c.select(F.col("vec_id").alias("centre"), *(F.col(a).alias(f"c{a}") for a in "xyz")), "centre")
    d2 = sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    both = c.join(centres, "category").select("category", "vec_id", "centre", d2.alias("d2"))
    return both.groupBy("category", "vec_id").agg(F.min_by("centre", F.struct("d2", "centre")).alias("centre"), F.round(F.sqrt(F.min("d2")), 8).alias("dist"))


def surface_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.surface_variation(_cloud(spark, sf_dir), 12).select("vec_id", F.round("variation", 8).alias("variation"))


def plane_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.plane_inliers(_cloud(spark, sf_dir), 24, 0.05)


_E = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS category, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_C = "c AS (SELECT vec_id, CAST(label AS BIGINT) AS category, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_D = "sqrt(list_sum(list_transform(list_zip(q.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _fps(points: str, d2: str, n: int) -> str:
    """DuckDB: greedy picks; each step holds every point's distance to the picks so far."""
    return f"""st AS (SELECT 0 AS step, p.category, p.vec_id, (SELECT min(vec_id) FROM {points} m WHERE m.category = p.category) AS pick, CAST('inf' AS DOUBLE) AS best FROM {points} p
UNION ALL SELECT step + 1, category, vec_id, first_value(vec_id) OVER (PARTITION BY category ORDER BY nb DESC, vec_id), nb FROM (SELECT s.step, s.category, s.vec_id, least(s.best, {d2}) AS nb FROM st s JOIN {points} a ON a.vec_id = s.vec_id JOIN {points} b ON b.vec_id = s.pick WHERE s.step < {n - 1}))"""


_FPS3 = _fps("c", "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2", 8)
_FPS64 = _fps("e", "list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", 5)
_FPS4 = _fps("c", "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2", 4)

QUERIES = {f.__name__: f for f in (bank_nn_distance, knn_topk, bank_linear, fps_select, greedy_coreset, sor_filter, voxel_downsample, mahalanobis_2d, masked_zscore_fusion, unit_sphere_norm, nearest_group, surface_variation, plane_ransac)}
ORACLES = {
    "bank_nn_distance": f"WITH {_E}, d AS (SELECT q.vec_id, b.vec_id AS bank_id, {_D} AS dist FROM e q, e b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0) SELECT vec_id, bank_id, round(dist, 8) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, bank_id) AS k FROM d) WHERE k = 1",
    "knn_topk": f"WITH {_E}, d AS (SELECT q.vec_id, b.vec_id AS bank_id, {_D} AS dist FROM e q, e b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0) SELECT vec_id, CAST(k AS INT) AS rank, bank_id, round(dist, 8) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, bank_id) AS k FROM d) WHERE k <= 5",
    "bank_linear": f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(e, lambda x: -2 * x)), 8) AS weight_sum, round(list_sum(list_transform(e, lambda x: x * x)), 8) AS bias FROM e WHERE vec_id % 2 = 0",
    "fps_select": f"WITH RECURSIVE {_C}, {_FPS3} SELECT DISTINCT category, CAST(step AS BIGINT) AS step, pick AS point FROM st",
    "greedy_coreset": f"WITH RECURSIVE {_E}, {_FPS64} SELECT DISTINCT category, CAST(step AS BIGINT) AS step, pick AS point FROM st",
    "sor_filter": f"WITH {_C}, d AS (SELECT q.vec_id, sqrt((q.x - b.x) ** 2 + (q.y - b.y) ** 2 + (q.z - b.z) ** 2) AS dist FROM c q, c b), m AS (SELECT vec_id, avg(dist) AS mean_dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS k FROM d) WHERE k <= 20 GROUP BY 1) SELECT vec_id, round(mean_dist, 8) AS mean_dist, mean_dist < (SELECT avg(mean_dist) + 2 * stddev_samp(mean_dist) FROM m) AS kept FROM m",
    "voxel_downsample": f"WITH {_C}, l AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM c) SELECT CAST(floor((x - mx + 0.05e0) / 0.1e0) AS BIGINT) AS vx, CAST(floor((y - my + 0.05e0) / 0.1e0) AS BIGINT) AS vy, CAST(floor((z - mz + 0.05e0) / 0.1e0) AS BIGINT) AS vz, count(*) AS n, round(avg(x) + 0.0, 7) AS x, round(avg(y) + 0.0, 7) AS y, round(avg(z) + 0.0, 7) AS z FROM c, l GROUP BY 1, 2, 3",
    "mahalanobis_2d": f"""WITH {_C}, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM c WHERE vec_id % 2 = 0), t AS (SELECT x - mx AS a, y - my AS b FROM c, m WHERE vec_id % 2 = 0),
s AS (SELECT count(*) AS n, sum((a * a + b * b) ** 2) AS f, sum(a * a) / count(*) AS xx, sum(a * b) / count(*) AS xy, sum(b * b) / count(*) AS yy FROM t),
u AS (SELECT *, (xx + yy) / 2 AS mu FROM s), v AS (SELECT *, ((xx - mu) ** 2 + (yy - mu) ** 2 + 2 * xy * xy) / 2 AS de, (f / n - (xx * xx + yy * yy + 2 * xy * xy)) / (2 * n) AS be FROM u),
w AS (SELECT *, least(de, greatest(be, 0)) / de AS sh FROM v), z AS (SELECT (1 - sh) * xx + sh * mu AS p, (1 - sh) * xy AS q, (1 - sh) * yy + sh * mu AS r FROM w)
SELECT vec_id, round(sqrt(((x - mx) ** 2 * r - 2 * (x - mx) * (y - my) * q + (y - my) ** 2 * p) / (p * r - q * q)), 7) AS dist FROM c, m, z WHERE vec_id % 2 = 1""",
    "masked_zscore_fusion": f"WITH p AS (SELECT a.vec_id, a.category, a.valid, a.amap AS one, b.amap AS two FROM ({PIXELS_SQL}) a JOIN ({PIXELS_SQL}) b ON a.vec_id = b.vec_id AND b.pix = 63 - a.pix), m AS (SELECT category, avg(one) AS m1, stddev_pop(one) AS s1, avg(two) AS m2, stddev_pop(two) AS s2 FROM p WHERE valid GROUP BY 1) SELECT vec_id, round(sum(f) + 0.0, 6) AS total, round(max(f), 6) AS peak FROM (SELECT vec_id, CASE WHEN valid THEN 0.7 * (one - m1) / (s1 + 1e-9) + 0.3 * (two - m2) / (s2 + 1e-9) ELSE 0 END AS f FROM p JOIN m USING (category)) GROUP BY 1",
    "unit_sphere_norm": f"WITH {_C}, m AS (SELECT category, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY 1), r AS (SELECT vec_id, category, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS r FROM c JOIN m USING (category)) SELECT vec_id, round(r / (max(r) OVER (PARTITION BY category) + 1e-6), 7) AS radius FROM r",
    "nearest_group": f"WITH RECURSIVE {_C}, {_FPS4}, k AS (SELECT DISTINCT category, pick FROM st), d AS (SELECT c.category, c.vec_id, k.pick, (c.x - b.x) ** 2 + (c.y - b.y) ** 2 + (c.z - b.z) ** 2 AS d2 FROM c JOIN k USING (category) JOIN c b ON b.vec_id = k.pick) SELECT category, vec_id, pick AS centre, round(sqrt(d2), 8) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, pick) AS n FROM d) WHERE n = 1",
}
