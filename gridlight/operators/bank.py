"""Feature banks: nearest neighbours, coresets and point-cloud filters.

Queries and bank are dealt into blocks, and every block of queries meets every block of the bank in a
task of its own; nothing passes the driver and no bank is broadcast, so neither's size matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlight.operators import neighbours
from gridlight.operators.neighbours import best_of
from gridlight.sources.shared import written

#: Vectors of a block of the bank, and of a block of queries; blocks of queries there are at least.
BANK_BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 20_000, 20_000, 8


def _block(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a block."""
    return t["vec_id"].to_numpy(), t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1) -> DataFrame:
    """(vec_id, rank, bank_id, dist): the k nearest bank vectors of each query by Euclidean distance, ties by bank_id.

    A pair of blocks gives the k best of each query, and the best of these over the bank's blocks are kept. A task
    holds one pair at a time, so its memory doesn't depend on the tables. An empty bank gives no rows; null vectors are left out.
    """
    bank_blocks, query_blocks = max(1, -(-bank.count() // BANK_BLOCK)), max(LEAST_BLOCKS, -(-queries.count() // QUERY_BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    q = queries.where("embedding is not null").select(F.col("vec_id").cast("long"), vector, own(query_blocks).alias("i"), every(bank_blocks, "j"))
    b = bank.where("embedding is not null").select(F.col("vec_id").cast("long"), vector, own(bank_blocks).alias("j"), every(query_blocks, "i"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("bank_id", pa.int64()), ("dist", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return pa.Table.from_pandas(pd.concat(best_of(*_block(left), *_block(right), k)), schema, preserve_index=False)

    found = q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, "vec_id long, bank_id long, dist double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("dist", "bank_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "bank_id", "dist")


def farthest_points(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, step, point): greedy k-centre of each group: begins at the smallest id, then always the farthest point (ties: smallest id)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id")
        x = np.array(f["embedding"].tolist(), float)
        best, at, picked = np.full(len(x), np.inf), 0, []
        for _ in range(min(n, len(x))):
            picked.append(at)
            best = np.minimum(best, ((x - x[at]) ** 2).sum(1))
            at = int(best.argmax())
        return pd.DataFrame({**{k: f[k].iloc[0] for k in keys}, "step": np.arange(len(picked)), "point": f["vec_id"].to_numpy()[picked]})

    kinds = dict(points.dtypes)
    return points.select(*keys, "vec_id", "embedding").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step long, point long")


def surface_variation(points: DataFrame, near: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, vec_id, variation): smallest share of the covariance's eigenvalues over the nearest points in space, oneself among them; 0 for a point alone."""
    keys = keys or []
    points = points.where("embedding is not null").select(*keys, "vec_id", "embedding")
    own = points.select(*keys, F.col("vec_id").alias("bank_id"), "embedding")
    lists = neighbours.nearest(points, points, near, keys)[0].join(own, [*keys, "bank_id"]).groupBy(*keys, "vec_id").agg(F.array_sort(F.collect_list("embedding")).alias("near"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rows in f["near"]:
                d = np.array([list(p) for p in rows], float)
                d = d - d.mean(0)
                values = np.linalg.eigvalsh(d.T @ d / max(1, len(d) - 1))
                out.append(float(max(values[0], 0) / max(values.sum(), 1e-12)))
            yield f[[*keys, "vec_id"]].assign(variation=out)

    kinds = dict(points.dtypes)
    return lists.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "vec_id"]) + ", variation double")


def outlier_filter(points: DataFrame, count: int, ratio: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, vec_id, mean_dist, kept): mean distance to the nearest points of the same cloud, oneself among them, against mean + ratio * deviation of the cloud.

    A cloud of at most ``count`` points is kept whole, as it has no neighbourhoods to compare; its mean_dist is over the points that it has.
    """
    keys = keys or []
    by = keys or [F.lit(0).alias("_all")]
    near = written(neighbours.nearest(points, points, count, keys)[0].groupBy(*keys, "vec_id").agg(F.avg("dist").alias("mean_dist")), "near")
    limit = near.groupBy(*by).agg((F.avg("mean_dist") + ratio * F.stddev_samp("mean_dist")).alias("limit"), F.count("*").alias("n"))
    both = near.join(limit, keys) if keys else near.crossJoin(F.broadcast(limit))  # one row
    return both.select(*keys, "vec_id", "mean_dist", ((F.col("n") <= count) | (F.col("mean_dist") < F.col("limit"))).alias("kept"))


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """(vx, vy, vz, n, x, y, z): the mean point of each voxel; voxels are counted from half a voxel below the smallest corner."""
    low = points.agg(*(F.min(c).alias(f"m{c}") for c in "xyz"))
    cell = lambda c: F.floor((F.col(c) - F.col(f"m{c}") + size / 2) / size)
    return points.crossJoin(F.broadcast(low)).groupBy(*(cell(c).alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def mahalanobis(train: DataFrame, test: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """(key, dist) of ``test`` rows to the mean of ``train`` under its Ledoit-Wolf shrunk covariance.

    All moments are sums over ``train`` (one pass for means, one for products); only they reach the driver.
    """
    d = len(dims)
    mean = np.array(train.agg(*(F.avg(c) for c in dims)).first(), float)
    centred = train.select(*((F.col(c) - float(m)).alias(c) for c, m in zip(dims, mean)))
    products = [F.sum(F.col(a) * F.col(b)) for a in dims for b in dims]
    norm = sum((F.col(c) ** 2 for c in dims), F.lit(0.0))
    n, fourth, *sums = centred.agg(F.count("*"), F.sum(norm**2), *products).first()
    cov = np.array(sums, float).reshape(d, d) / n
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
    beta = min(delta, max(0.0, (fourth / n - (cov**2).sum()) / (d * n)))
    shrink = beta / delta if delta else 0.0
    inverse = np.linalg.inv((1 - shrink) * cov + shrink * mu * np.eye(d))
    x = [F.col(c) - float(m) for c, m in zip(dims, mean)]
    square = sum((x[i] * x[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    return test.select(key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("dist"))


def fuse(pixels: DataFrame, first: str, second: str, weight: float, group: str = "category") -> DataFrame:
    """``pixels`` with ``fused``: the weighted sum of both maps' z-scores over the group's valid pixels, 0 elsewhere."""
    stats = pixels.where("valid").groupBy(group).agg(*(f(c).alias(f"{n}_{c}") for c in (first, second) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-9)
    fused = F.when(F.col("valid"), weight * z(first) + (1 - weight) * z(second)).otherwise(0.0)
    return pixels.join(F.broadcast(stats), group).withColumn("fused", fused).select(*pixels.columns, "fused")


def plane_inliers(points: DataFrame, tries: int, within: float) -> DataFrame:
    """(trial, inliers) of the best of ``tries`` planes through three points each: one pass picks the points, one counts.

    A trial's points are those of the smallest hashes of (vec_id, number of the pick); picks of one
    point twice, or on a line, make no plane, and without planes there are no rows.
    """
    pick = lambda k: F.min_by(F.array("x", "y", "z"), F.struct(F.xxhash64("vec_id", F.lit(k)), "vec_id")).alias(f"p{k}")
    place = points.agg(*map(pick, range(3 * tries))).first()
    planes = []
    for t in range(tries):
        if place[3 * t] is None:
            break
        a, b, c = (np.array(place[3 * t + j], float) for j in range(3))
        normal = np.cross(b - a, c - a)
        size = float(np.linalg.norm(normal))
        if size > 1e-12:
            normal = normal / size
            planes.append((t, *map(float, normal), float(normal @ a)))
    held = points.sparkSession.createDataFrame(planes, "trial int, a double, b double, c double, d double")
    near = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") - F.col("d")) < within
    return points.join(F.broadcast(held), near).groupBy("trial").agg(F.count("*").alias("inliers")).orderBy(F.col("inliers").desc(), "trial").limit(1)
