"""Organized-grid queries: 8 x 8 scans made of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.operators import grid
from gridlight.sources.tables import table


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image, arrays in row-major order: its scores, its mask (odd images only) and its validity."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").cast("array<double>").alias("amap"))
    mask = F.transform(F.reverse("amap"), lambda x: (x > 0.1) & (F.col("vec_id") % 2 == 1))
    return e.withColumns({"mask": mask, "valid": F.transform("amap", lambda x: F.abs(x) > 0.01), "h": F.lit(8), "w": F.lit(8)})


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel: position (u, v, 2 + e), validity."""
    return grid.long_form(scans(spark, sf_dir)).select("vec_id", "pix", "v", "u", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), (F.col("amap") + 2.0).alias("z"), "valid", "amap")


def grid_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.normals(surface(spark, sf_dir)), "nx", "ny", "nz")


def grazing_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.grazing(surface(spark, sf_dir)), "cos")


def sensor_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop probability of every valid pixel, calibrated to a mean of 0.11 for each image, and the draw that decides."""
    return _rounded(grid.dropout(grid.grazing(surface(spark, sf_dir))), "p_drop")


def backproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = surface(spark, sf_dir).select("vec_id", "v", "u", F.when(F.col("valid"), F.col("z")).otherwise(F.lit(float("inf"))).alias("depth"))
    return _rounded(grid.backproject(depth, 2.0, 2.0, 8, 8), "x", "y", "z")


def bilinear_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.upsample(scans(spark, sf_dir), 2), "value")


def local_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.mean_pool(scans(spark, sf_dir)), "value")


def robust_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans(spark, sf_dir).select("vec_id", F.explode("amap").alias("a"))
    p = s.groupBy("vec_id").agg(F.percentile("a", 0.99).alias("p99"))
    unit = F.least(F.greatest(F.col("a") / (F.col("p99") + 1e-9), F.lit(0.0)), F.lit(1.0))
    return s.join(p, "vec_id").groupBy("vec_id").agg(F.round(F.sum(unit), 6).alias("total"), F.round(F.max("p99"), 9).alias("p99"))


def crop_center_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of the valid pixels, their centroid, and how many stay within 4 units of it after scaling by 0.5."""
    return _rounded(grid.box_center_clip(surface(spark, sf_dir), 0.5, 1.6), "cx", "cy", "cz")


def depth_diff_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pixels between the depth of each image and of the next one: difference above 0.3 of the amplitude."""
    s = surface(spark, sf_dir).select("vec_id", "pix", F.when(F.col("valid"), F.col("z")).alias("d"))
    other = s.select((F.col("vec_id") - 1).alias("vec_id"), "pix", F.col("d").alias("d1"))
    both = s.join(other, ["vec_id", "pix"]).where("d is not null and d1 is not null")
    return both.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum((F.abs(F.col("d1") - F.col("d")) > 0.3 * 0.5).cast("long")).alias("changed"))


def defect_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic defect in every image, its kind, place and size by the image's id: pixels in the mask and the summed displacement."""
    return _rounded(grid.defect(surface(spark, sf_dir), 8, 8, 0.05), "moved")


def mesh_deform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian bump around one vertex of each image's mesh."""
    return _rounded(grid.deform(surface(spark, sf_dir), 1.0), "amplitude", "sum_z")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(0.0), 6) + F.lit(0.0) for c in columns})


PIXELS_SQL = """SELECT vec_id, label AS category, i AS pix, i // 8 AS v, i % 8 AS u, CAST(embedding[i + 1] AS DOUBLE) AS amap, CAST(embedding[64 - i] AS DOUBLE) > 0.1 AND vec_id % 2 = 1 AS mask, abs(CAST(embedding[i + 1] AS DOUBLE)) > 0.01 AS valid FROM embeddings, range(0, 64) t(i)"""
_S = f"s AS (SELECT vec_id, pix, v, u, CAST(u AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y, amap + 2 AS z, valid, amap FROM ({PIXELS_SQL}))"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c} + 0.0, 6) + 0.0 AS {c}" for c in columns)


def lattice_sql(seed: str, x: str, y: str) -> str:
    return f"(((({seed}) * 7919 + ({x}) * 104729 + ({y}) * 1299709) * 48271 % 1000003 + 1000003) % 1000003 / 1000003e0)"


def _draw(k: int, low: float = 0.0, high: float = 1.0) -> str:
    return f"({low}e0 + {high - low!r} * {lattice_sql('vec_id', str(k), str(31 * k))})"


def _beside(c: str, t: str) -> str:
    """Sum of the valid forward and backward differences of ``c`` in the window ``t``."""
    return f"CASE WHEN valid AND lead(valid) OVER {t} THEN lead({c}) OVER {t} - {c} ELSE 0 END + CASE WHEN valid AND lag(valid) OVER {t} THEN {c} - lag({c}) OVER {t} ELSE 0 END"


_NORMALS = f"""WITH {_S},
n AS (SELECT vec_id, v, u, x, y, z, valid, {", ".join(f"{_beside(c, f'w{t}')} AS {t}{c}" for t in "vu" for c in "xyz")} FROM s WINDOW wv AS (PARTITION BY vec_id, u ORDER BY v), wu AS (PARTITION BY vec_id, v ORDER BY u)),
c AS (SELECT *, vy * uz - vz * uy AS a, vz * ux - vx * uz AS b, vx * uy - vy * ux AS c FROM n),
k AS (SELECT *, sqrt(a * a + b * b + c * c) AS len, CASE WHEN a * x + b * y + c * z > 0 THEN -1e0 ELSE 1e0 END AS sg FROM c),
o AS (SELECT vec_id, v, u, CASE WHEN valid AND len > 1e-12 THEN sg * a / len ELSE 0 END AS nx, CASE WHEN valid AND len > 1e-12 THEN sg * b / len ELSE 0 END AS ny, CASE WHEN valid AND len > 1e-12 THEN sg * c / len ELSE 0 END AS nz FROM k)
SELECT vec_id, v, u, {_r('nx', 'ny', 'nz')} FROM o"""

_GRAZING = f"""{_S},
q AS (SELECT vec_id, v, u, valid, CASE WHEN valid THEN x ELSE 0 END AS x, CASE WHEN valid THEN y ELSE 0 END AS y, CASE WHEN valid THEN z ELSE 0 END AS z FROM s),
d AS (SELECT vec_id, v, u, valid, {", ".join(f"(coalesce(lead({c}) OVER w{t}, {c}) - coalesce(lag({c}) OVER w{t}, {c})) / CASE WHEN {t} IN (0, 7) THEN 1e0 ELSE 2e0 END AS {t}{c}" for t in "vu" for c in "xyz")} FROM q WINDOW wv AS (PARTITION BY vec_id, u ORDER BY v), wu AS (PARTITION BY vec_id, v ORDER BY u)),
gr AS (SELECT vec_id, v, u, valid, vy * uz - vz * uy AS a, vz * ux - vx * uz AS b, vx * uy - vy * ux AS c FROM d),
g AS (SELECT vec_id, v, u, valid, CASE WHEN sqrt(a * a + b * b + c * c) > 1e-12 THEN abs(c) / sqrt(a * a + b * b + c * c) ELSE 1e0 END AS cos FROM gr)"""

QUERIES = {f.__name__: f for f in (grid_normals, grazing_cos, sensor_dropout, backproject, bilinear_upsample, local_mean_pool, robust_normalise, crop_center_clip, depth_diff_truth, defect_profile, mesh_deform)}
ORACLES = {
    "grid_normals": _NORMALS,
    "grazing_cos": f"WITH {_GRAZING} SELECT vec_id, v, u, valid, {_r('cos')} FROM g",
    "sensor_dropout": f"WITH {_GRAZING}, q1 AS (SELECT *, least(0.6e0 * (1 / least(greatest(cos, 0.15e0), 1e0) - 1), 0.6e0) AS p FROM g WHERE valid), m AS (SELECT vec_id, greatest(avg(p), 1e-6) AS m FROM q1 GROUP BY 1) SELECT vec_id, v, u, round(p_drop + 0.0, 6) + 0.0 AS p_drop, (vec_id * 7919 + v * 104729 + u * 1299709) % 1000003 / 1000003e0 < p_drop AS dropped FROM (SELECT vec_id, v, u, least(p * (0.11e0 / m), 0.6e0) AS p_drop FROM q1 JOIN m USING (vec_id))",
    "backproject": f"WITH {_S} SELECT vec_id, v, u, {_r('x', 'y', 'z')} FROM (SELECT vec_id, v, u, CASE WHEN valid THEN (u - 4e0) * z / 2 ELSE 0 END AS x, CASE WHEN valid THEN (v - 4e0) * z / 2 ELSE 0 END AS y, CASE WHEN valid THEN z ELSE 0 END AS z FROM s)",
    "bilinear_upsample": f"""WITH o AS (SELECT r AS row, c AS col, greatest((r + 0.5e0) / 2 - 0.5e0, 0) AS fy, greatest((c + 0.5e0) / 2 - 0.5e0, 0) AS fx FROM range(0, 16) a(r), range(0, 16) b(c)),
t AS (SELECT row, col, CAST(floor(fy) AS INT) AS y0, least(CAST(floor(fy) AS INT) + 1, 7) AS y1, CAST(floor(fx) AS INT) AS x0, least(CAST(floor(fx) AS INT) + 1, 7) AS x1, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM o),
a AS (SELECT vec_id, row, col, {", ".join(f"CAST(embedding[{y} * 8 + {x} + 1] AS DOUBLE) AS {y}{x}" for y in ("y0", "y1") for x in ("x0", "x1"))}, wy, wx FROM embeddings, t)
SELECT vec_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, {_r('value')} FROM (SELECT vec_id, row, col, (1 - wy) * ((1 - wx) * y0x0 + wx * y0x1) + wy * ((1 - wx) * y1x0 + wx * y1x1) AS value FROM a)""",
    "local_mean_pool": f"WITH p AS ({PIXELS_SQL}) SELECT a.vec_id, CAST(a.pix AS INT) AS pix, round(sum(b.amap) / 9 + 0.0, 6) + 0.0 AS value FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1 GROUP BY 1, 2",
    "robust_normalise": f"WITH p AS ({PIXELS_SQL}), q AS (SELECT vec_id, quantile_cont(amap, 0.99) AS p99 FROM p GROUP BY 1) SELECT vec_id, round(sum(least(greatest(amap / (p99 + 1e-9), 0), 1)), 6) AS total, round(max(p99), 9) AS p99 FROM p JOIN q USING (vec_id) GROUP BY 1",
    "crop_center_clip": f"WITH {_S}, b AS (SELECT vec_id, min(v) AS v0, max(v) + 1 AS v1, min(u) AS u0, max(u) + 1 AS u1, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM s WHERE valid GROUP BY 1) SELECT vec_id, CAST(v0 AS INT) AS v0, CAST(v1 AS INT) AS v1, CAST(u0 AS INT) AS u0, CAST(u1 AS INT) AS u1, {_r('cx', 'cy', 'cz')}, n_valid, n_kept FROM b JOIN (SELECT vec_id, count(*) AS n_valid, count(*) FILTER (WHERE sqrt(((x - cx) * 0.5) ** 2 + ((y - cy) * 0.5) ** 2 + ((z - cz) * 0.5) ** 2) < 1.6) AS n_kept FROM s JOIN b USING (vec_id) WHERE valid GROUP BY 1) USING (vec_id)",
    "depth_diff_truth": f"WITH {_S} SELECT a.vec_id, count(*) AS n, CAST(sum(CAST(abs(b.z - a.z) > 0.3e0 * 0.5e0 AS INT)) AS BIGINT) AS changed FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.pix = b.pix WHERE a.valid AND b.valid GROUP BY 1",
    "defect_profile": f"""WITH {_S}, d AS (SELECT *, CAST(floor({_draw(0)} * 4) AS INT) AS kind, greatest(max(z) OVER w - min(z) OVER w, 1e-6) AS ext, v - {_draw(1, 0.2, 0.8)} * 8 AS dy, u - {_draw(2, 0.2, 0.8)} * 8 AS dx, {_draw(3, 0.0, 3.141592653589793)} AS a FROM s WHERE valid WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT *, dy * cos(a) + dx * sin(a) AS al, dx * cos(a) - dy * sin(a) AS ac FROM d),
f AS (SELECT *, greatest(CASE WHEN kind = 2 THEN CASE WHEN abs(al) < {_draw(6, 0.15, 0.4)} * 8 / 2 THEN 1 - (ac / ({_draw(7, 0.004, 0.012)} * 8)) ** 2 ELSE 0 END ELSE 1 - ((al / ({_draw(4, 0.03, 0.14)} * 8)) ** 2 + (ac / ({_draw(5, 0.03, 0.14)} * 8)) ** 2) END, 0) AS f FROM p)
SELECT vec_id, kind, CAST(count(*) FILTER (WHERE f > 0.05e0) AS BIGINT) AS n_mask, round(sum(CASE WHEN kind = 1 THEN 1 ELSE -1 END * CASE WHEN kind = 2 THEN {_draw(8, 0.2, 0.5)} ELSE {_draw(8, 0.15, 0.35)} END * ext * CASE WHEN f > 0.05e0 THEN f ELSE 0 END) + 0.0, 6) + 0.0 AS moved FROM f GROUP BY 1, 2""",
    "mesh_deform": f"WITH {_S}, e AS (SELECT vec_id, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS ext, count(*) AS n FROM s GROUP BY 1), k AS (SELECT vec_id, ext * {_draw(1, 0.05, 0.12)} AS radius, ext * {_draw(2, 0.03, 0.06)} AS amp, floor({_draw(3)} * n) AS vertex FROM e), c AS (SELECT s.vec_id, x AS px, y AS py, z AS pz FROM s JOIN k USING (vec_id) WHERE pix = vertex) SELECT vec_id, round(max(amp), 6) + 0.0 AS amplitude, round(sum(z + amp * exp(-((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) / (2 * radius ** 2))), 6) + 0.0 AS sum_z FROM s JOIN k USING (vec_id) JOIN c USING (vec_id) GROUP BY 1",
}
