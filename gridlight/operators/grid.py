"""Kernels over organized grids: stencils as windows over rows and columns, or within a row's array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(scans: DataFrame) -> DataFrame:
    """One row per pixel of array-form scans: pix, v, u and the values."""
    named = scans.select("vec_id", "category", "w", F.posexplode(F.arrays_zip("amap", "mask", "valid")).alias("pix", "x"))
    return named.select("vec_id", "category", "pix", F.expr("pix div w").alias("v"), (F.col("pix") % F.col("w")).cast("long").alias("u"), "x.amap", "x.mask", "x.valid")


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _norm(x: list[Column]) -> Column:
    return F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])


def lattice(seed: Column, x: Column, y: Column) -> Column:
    """A number in [0, 1) for each whole lattice point, a fixed function of its place."""
    return F.pmod((seed * 7919 + x * 104729 + y * 1299709) * 48271, F.lit(1000003)) / F.lit(1000003.0)


def _lines() -> dict:
    return {"v": Window.partitionBy("vec_id", "u").orderBy("v"), "u": Window.partitionBy("vec_id", "v").orderBy("u")}


def normals(points: DataFrame) -> DataFrame:
    """Unit normals toward the origin: cross product of the sums of valid forward and backward differences; zero if undefined."""
    sums = {}
    for axis, w in _lines().items():
        for c in "xyz":
            ahead = F.when(F.col("valid") & F.lead("valid").over(w), F.lead(c).over(w) - F.col(c)).otherwise(0.0)
            behind = F.when(F.col("valid") & F.lag("valid").over(w), F.col(c) - F.lag(c).over(w)).otherwise(0.0)
            sums[f"t{axis}{c}"] = ahead + behind
    t = points.withColumns(sums)
    n = _cross([F.col(f"tv{c}") for c in "xyz"], [F.col(f"tu{c}") for c in "xyz"])
    t = t.withColumns(dict(zip("abc", n)))
    n = [F.col(c) for c in "abc"]
    sign = F.when(n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z") > 0, -1.0).otherwise(1.0)
    known = F.col("valid") & (_norm(n) > 1e-12)
    return t.select("vec_id", "v", "u", *(F.when(known, sign * x / _norm(n)).otherwise(0.0).alias(m) for x, m in zip(n, ("nx", "ny", "nz"))))


def grazing(points: DataFrame) -> DataFrame:
    """(vec_id, v, u, valid, cos): cosine between the viewing axis and the normal of the gradients; 1 where there is none.

    Gradients are central, and one-sided at the grid's edges; invalid points count as the origin.
    """
    zeroed = points.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(0.0) for c in "xyz"})
    slopes = {}
    for axis, w in _lines().items():
        for c in "xyz":
            there, back = F.lead(c).over(w), F.lag(c).over(w)
            slopes[f"g{axis}{c}"] = (F.coalesce(there, F.col(c)) - F.coalesce(back, F.col(c))) / F.when(there.isNull() | back.isNull(), 1.0).otherwise(2.0)
    g = zeroed.withColumns(slopes)
    g = g.withColumns(dict(zip("abc", _cross([F.col(f"gv{c}") for c in "xyz"], [F.col(f"gu{c}") for c in "xyz"]))))
    length = _norm([F.col(c) for c in "abc"])
    return g.select("vec_id", "v", "u", "valid", F.when(length > 1e-12, F.abs("c") / length).otherwise(1.0).alias("cos"))


#: Fixed values of the sensor model: axial noise at normal incidence, least cosine, mean and most drop probability, share and size of spikes.
SIGMA, LEAST_COS, DROP_MEAN, DROP_MOST, SPIKES, SPIKE_SIZE = 8e-4, 0.15, 0.11, 0.6, 0.02, 0.02


def excess() -> Column:
    """How much more than at normal incidence the sensor's noise is, less one: 1 / cos - 1, the cosine being clamped."""
    return 1 / F.least(F.greatest(F.col("cos"), F.lit(LEAST_COS)), F.lit(1.0)) - 1


def dropout(cosines: DataFrame, mean: float = DROP_MEAN, most: float = DROP_MOST) -> DataFrame:
    """Drop probability of every valid pixel, and a draw that is a fixed function of the pixel.

    It grows with 1 / cos - 1 up to ``most``, is scaled to the given mean over an image's valid pixels, and cut at ``most`` again.
    """
    grid = cosines.where("valid").withColumn("p", F.least(F.lit(most) * excess(), F.lit(most)))
    m = grid.groupBy("vec_id").agg(F.greatest(F.avg("p"), F.lit(1e-6)).alias("m"))
    p = F.least(F.col("p") * (mean / F.col("m")), F.lit(most))
    draw = (F.col("vec_id") * 7919 + F.col("v") * 104729 + F.col("u") * 1299709) % 1000003 / F.lit(1000003.0)
    return grid.join(m, "vec_id").withColumn("p_drop", p).select("vec_id", "v", "u", "p_drop", (draw < F.col("p_drop")).alias("dropped"))


def backproject(depth: DataFrame, fx: float, fy: float, h: int, w: int) -> DataFrame:
    """Pinhole points of depths; infinite depths become the origin."""
    known = F.abs("depth") < float("inf")
    at = lambda c: F.when(known, c).otherwise(0.0)
    return depth.select("vec_id", "v", "u", at((F.col("u") - w / 2) * F.col("depth") / fx).alias("x"), at((F.col("v") - h / 2) * F.col("depth") / fy).alias("y"), at(F.col("depth")).alias("z"))


def upsample(scans: DataFrame, times: int, h: int = 8, w: int = 8) -> DataFrame:
    """Bilinear upsampling with half-pixel centres, within each row; source positions before the first pixel stay on it."""
    cells = []
    for r in range(h * times):
        for c in range(w * times):
            fy, fx = max((r + 0.5) / times - 0.5, 0.0), max((c + 0.5) / times - 0.5, 0.0)
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            cells.append((r, c, y0 * w + x0, y0 * w + x1, y1 * w + x0, y1 * w + x1, fy - y0, fx - x0))
    taps = scans.sparkSession.createDataFrame(cells, "row int, col int, p00 int, p01 int, p10 int, p11 int, wy double, wx double")
    both = scans.select("vec_id", "amap").join(F.broadcast(taps), how="cross")
    a = lambda p: F.get("amap", F.col(p))
    value = (1 - F.col("wy")) * ((1 - F.col("wx")) * a("p00") + F.col("wx") * a("p01")) + F.col("wy") * ((1 - F.col("wx")) * a("p10") + F.col("wx") * a("p11"))
    return both.select("vec_id", "row", "col", value.alias("value"))


def pooled(column: str) -> Column:
    """The 3 x 3 mean at every pixel of an array column, with zeros beyond the border, within each row (h and w are columns)."""
    at = lambda i, dv, du: F.when((F.floor(i / F.col("w")) + dv).between(0, F.col("h") - 1) & (i % F.col("w") + du).between(0, F.col("w") - 1), F.get(column, (i + dv * F.col("w") + du).cast("int"))).otherwise(0.0)
    return F.transform(F.col(column), lambda _, i: sum((at(i, dv, du) for dv in (-1, 0, 1) for du in (-1, 0, 1)), F.lit(0.0)) / 9)


def mean_pool(scans: DataFrame) -> DataFrame:
    """3 x 3 mean at every pixel, with zeros beyond the border, within each row."""
    return scans.select("vec_id", F.posexplode(pooled("amap")).alias("pix", "value"))


def eroded(scans: DataFrame) -> DataFrame:
    """``scans`` with ``eroded``: valid pixels whose four neighbours are valid too, none beyond the border; within each row."""
    at = lambda i, dv, du: F.when((F.floor(i / F.col("w")) + dv).between(0, F.col("h") - 1) & (i % F.col("w") + du).between(0, F.col("w") - 1), F.get("valid", (i + dv * F.col("w") + du).cast("int"))).otherwise(False)
    inner = F.transform("valid", lambda ok, i: ok & at(i, -1, 0) & at(i, 1, 0) & at(i, 0, -1) & at(i, 0, 1))
    return scans.withColumn("eroded", inner)


def box_center_clip(points: DataFrame, scale: float, within: float) -> DataFrame:
    """Half-open bounding box and centroid of valid pixels, and the number of them within a radius after centring and scaling."""
    valid = points.where("valid")
    box = valid.groupBy("vec_id").agg(F.min("v").cast("int").alias("v0"), (F.max("v") + 1).cast("int").alias("v1"), F.min("u").cast("int").alias("u0"), (F.max("u") + 1).cast("int").alias("u1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    far = F.sqrt(sum((((F.col(c) - F.col(f"c{c}")) * scale) ** 2 for c in "xyz"), F.lit(0.0)))
    kept = valid.join(box, "vec_id").groupBy("vec_id").agg(F.count("*").alias("n_valid"), F.sum((far < within).cast("long")).alias("n_kept"))
    return box.join(kept, "vec_id")


#: Kinds of synthetic defects, by number.
DENT, BUMP, SCRATCH, CONTAMINATION = range(4)


def draw(k: int, low: float = 0.0, high: float = 1.0) -> Column:
    """The k-th number of an image between two limits, a fixed function of its id."""
    return low + (high - low) * lattice(F.col("vec_id"), F.lit(k), F.lit(31 * k))


def defect(points: DataFrame, h: int, w: int, edge: float) -> DataFrame:
    """(vec_id, kind, n_mask, moved): a synthetic defect in every image, the pixels that its profile exceeds ``edge`` in, and their displacement.

    The profile is a rotated ellipse, 1 - r^2 cut at 0, or for a scratch a thin line of limited length; it is
    0 off the object. Valid pixels move along the normal by a share of the object's extent in z: up for
    bumps, down for all others.
    """
    y, x, a = F.col("v") - draw(1, 0.2, 0.8) * h, F.col("u") - draw(2, 0.2, 0.8) * w, draw(3, 0.0, math.pi)
    along, across = y * F.cos(a) + x * F.sin(a), x * F.cos(a) - y * F.sin(a)
    blob = 1 - ((along / (draw(4, 0.03, 0.14) * h)) ** 2 + (across / (draw(5, 0.03, 0.14) * w)) ** 2)
    line = F.when(F.abs(along) < draw(6, 0.15, 0.4) * h / 2, 1 - (across / (draw(7, 0.004, 0.012) * h)) ** 2)
    kind = F.floor(draw(0) * 4).cast("int")
    extent = Window.partitionBy("vec_id")
    on = points.where("valid").withColumns({"kind": kind, "extent": F.greatest(F.max("z").over(extent) - F.min("z").over(extent), F.lit(1e-6))})
    on = on.withColumn("f", F.greatest(F.when(F.col("kind") == SCRATCH, line).otherwise(blob), F.lit(0.0)))
    share = F.when(F.col("kind") == SCRATCH, draw(8, 0.2, 0.5)).otherwise(draw(8, 0.15, 0.35))
    moved = F.when(F.col("kind") == BUMP, 1.0).otherwise(-1.0) * share * F.col("extent") * F.when(F.col("f") > edge, F.col("f")).otherwise(0.0)
    return on.withColumn("moved", moved).groupBy("vec_id", "kind").agg(F.sum((F.col("f") > edge).cast("long")).alias("n_mask"), F.sum("moved").alias("moved"))


def deform(points: DataFrame, sign: float) -> DataFrame:
    """(vec_id, amplitude, sum_z): a Gaussian displacement along z around one vertex, in the direction of ``sign``.

    Width and amplitude are shares of the length of the bounding box's diagonal; they and the vertex are
    fixed functions of the image's id.
    """
    diagonal = F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    size = points.groupBy("vec_id").agg(diagonal.alias("ext"), F.count("*").alias("n"))
    size = size.select("vec_id", (F.col("ext") * draw(1, 0.05, 0.12)).alias("radius"), (F.col("ext") * draw(2, 0.03, 0.06)).alias("amplitude"), F.floor(draw(3) * F.col("n")).alias("vertex"))
    all_ = points.join(size, "vec_id")
    centre = all_.where("pix = vertex").select("vec_id", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    moved = F.col("z") + sign * F.col("amplitude") * F.exp(-d2 / (2 * F.col("radius") ** 2))
    return all_.join(centre, "vec_id").groupBy("vec_id").agg(F.max("amplitude").alias("amplitude"), F.sum(moved).alias("sum_z"))
