"""Raw scans to the grid that detectors look at, as one operator: background, outliers of each scan, crop, resize, erosion, physical scale, clip."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.operators import bank


#: Pixels of the grid that a batch of made scans has, about; at least one scan.
PIXELS = 1 << 18


@dataclass(frozen=True)
class Recipe:
    """Side of the grid, neighbours and deviations of the outlier filter, units of position, and the largest distance from the centroid in these."""

    size: int = 256
    neighbours: int = 20
    ratio: float = 2.0
    scale: float = 0.05
    clip: float = 4.0


def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, weight of the upper, nearest) source places of ``size`` target places with half-pixel centres; beyond the border they are mirrored at the border pixels' centres."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    at = np.abs(at)
    at = np.where(at > n - 1, 2 * (n - 1) - at, at)
    at = np.clip(at, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low, np.minimum(np.floor(at + 0.5).astype(int), n - 1)


def resized(grid: np.ndarray, size: int, smooth: bool) -> np.ndarray:
    """A grid (h, w, ..) on ``size`` x ``size`` places, by bilinear weights or by the nearest."""
    (y0, y1, fy, ny), (x0, x1, fx, nx) = taps(grid.shape[0], size), taps(grid.shape[1], size)
    if not smooth:
        return grid[ny][:, nx]
    fy, fx = (f.reshape(s + (1,) * (grid.ndim - 2)) for f, s in ((fy, (-1, 1)), (fx, (1, -1))))
    rows = grid[y0] * (1 - fy) + grid[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def eroded(valid: np.ndarray) -> np.ndarray:
    """Valid places all of whose four neighbours are valid, none beyond the border."""
    pad = np.pad(valid, 1)
    return valid & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]


def one_scan(xyz: np.ndarray, valid: np.ndarray, gt: np.ndarray, recipe: Recipe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, validity, truth) of a scan on the recipe's grid, from its positions (h, w, 3) and what is left of it. A scan without a valid pixel is empty."""
    if not valid.any():
        return np.zeros((recipe.size, recipe.size, 3)), np.zeros((recipe.size, recipe.size), bool), np.zeros((recipe.size, recipe.size), bool)
    ys, xs = np.nonzero(valid)
    box = np.s_[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    xyz = resized(xyz[box], recipe.size, True)
    valid = eroded(resized(valid[box], recipe.size, False))  # bilinear positions at the edge are mixed with the background's
    gt = resized(gt[box], recipe.size, False) & valid
    centre = xyz[valid].mean(0) if valid.any() else np.zeros(3)
    xyz = (xyz - centre) / recipe.scale
    valid = valid & (np.linalg.norm(xyz, axis=2) < recipe.clip)
    return xyz * valid[..., None], valid, gt & valid


def _numbers(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def made(batch: pa.RecordBatch, kept: list[str], recipe: Recipe) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` and the new x, y, z, valid, gt, h and w of a batch of scans, about ``PIXELS`` pixels at a time."""
    step = max(1, PIXELS // recipe.size**2)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        out = [[] for _ in range(5)]
        for *place, ok, gt, gone, h, w in zip(*(part[c] for c in ("x", "y", "z", "valid", "gt", "_gone")), part["h"].to_pylist(), part["w"].to_pylist()):
            xyz = np.stack([_numbers(c).astype(float) for c in place], 1).reshape(h, w, 3)
            ok = _numbers(ok).astype(bool)
            if gone.is_valid:
                ok[_numbers(gone)] = False
            truth = np.array([bool(g) for g in gt.as_py()]) if gt.is_valid else np.zeros(h * w, bool)
            xyz, ok, truth = one_scan(np.where(np.isfinite(xyz), xyz, 0.0), ok.reshape(h, w), truth.reshape(h, w), recipe)
            for held, one in zip(out, (*np.moveaxis(xyz, 2, 0), ok, truth)):
                held.append(one.ravel())
        ends = pa.array(np.arange(part.num_rows + 1) * recipe.size**2, pa.int32())
        arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(one))) for one in out]
        sides = [pa.array(np.full(part.num_rows, recipe.size, np.int32))] * 2
        yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *arrays, *sides], names=[*kept, "x", "y", "z", "valid", "gt", "h", "w"])


def preprocess(scans: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """``scans`` (vec_id, x, y, z, gt, h, w and more) on one grid: x, y, z, valid, gt as arrays of size * size, h and w the size.

    The background is what lies exactly in the origin or isn't finite. Outliers are dropped by each scan's own limits, over a join of near
    points of the same scan; a scan with no more points than neighbours keeps all. A null gt means no defect. vec_ids are
    unique. Other columns pass through; one named valid is replaced. All but the outliers stays within a scan's row. Scans are
    made and sent on in batches of about ``PIXELS`` pixels, so a task's memory doesn't grow with its rows.
    """
    zipped = F.arrays_zip("x", "y", "z")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    there = lambda e: finite(e.x) & finite(e.y) & finite(e.z) & ((e.x != 0) | (e.y != 0) | (e.z != 0))
    rows = scans.drop("valid").withColumn("valid", F.transform(zipped, there))
    each = rows.select(F.col("vec_id").alias("_scan"), F.posexplode(F.arrays_zip("x", "y", "z", "valid")).alias("_pix", "e")).where("e.valid")
    points = each.select("_scan", F.col("_pix").cast("long").alias("vec_id"), F.array(*(F.col(f"e.{c}").cast("double") for c in "xyz")).alias("embedding"))
    gone = bank.outlier_filter(points, recipe.neighbours, recipe.ratio, ["_scan"]).where("not kept").groupBy("_scan").agg(F.collect_list("vec_id").alias("_gone"))  # pixels of one scan
    both = rows.join(gone, F.col("vec_id") == F.col("_scan"), "left").drop("_scan")
    kept = [c for c in rows.columns if c not in ("x", "y", "z", "valid", "gt", "h", "w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from made(batch, kept, recipe)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "x array<double>, y array<double>, z array<double>, valid array<boolean>, gt array<boolean>, h int, w int"])
    return both.select(*kept, "x", "y", "z", "valid", "gt", "h", "w", "_gone").mapInArrow(run, schema)
