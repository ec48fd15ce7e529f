"""The chain from raw scans to the common grid, against loops over pixels."""

import numpy as np
import pytest

from gridlight.operators import preprocess
from gridlight.operators.preprocess import Recipe


def plain(xyz, gt, recipe):
    """One scan by loops: xyz (h, w, 3), gt (h, w)."""
    h, w, _ = xyz.shape
    valid = {(i, j) for i in range(h) for j in range(w) if np.isfinite(xyz[i, j]).all() and (xyz[i, j] != 0).any()}
    if len(valid) > recipe.neighbours:
        mean = {p: np.mean(sorted(np.linalg.norm(xyz[p] - xyz[q]) for q in valid)[: recipe.neighbours]) for p in valid}
        m = np.array([*mean.values()])
        valid = {p for p in valid if mean[p] < m.mean() + recipe.ratio * m.std(ddof=1)}
    n = recipe.size
    empty = np.zeros((n, n, 3)), np.zeros((n, n), bool), np.zeros((n, n), bool)
    if not valid:
        return empty
    y0, y1, x0, x1 = min(i for i, _ in valid), max(i for i, _ in valid) + 1, min(j for _, j in valid), max(j for _, j in valid) + 1

    def place(k, size):
        at = (k + 0.5) * size / n - 0.5
        if at < 0:
            at = -at
        if at > size - 1:
            at = 2 * (size - 1) - at
        return min(max(at, 0), size - 1)

    out, ok, truth = empty
    clean = np.where(np.isfinite(xyz), xyz, 0)
    for i in range(n):
        for j in range(n):
            a, b = place(i, y1 - y0), place(j, x1 - x0)
            ia, jb = int(a), int(b)
            for di, wi in ((0, 1 - (a - ia)), (1, a - ia)):
                for dj, wj in ((0, 1 - (b - jb)), (1, b - jb)):
                    out[i, j] += wi * wj * clean[y0 + min(ia + di, y1 - y0 - 1), x0 + min(jb + dj, x1 - x0 - 1)]
            near = y0 + min(int(a + 0.5), y1 - y0 - 1), x0 + min(int(b + 0.5), x1 - x0 - 1)
            ok[i, j], truth[i, j] = near in valid, gt[near]
    inner = np.array([[ok[i, j] and all(0 <= p < n and 0 <= q < n and ok[p, q] for p, q in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1))) for j in range(n)] for i in range(n)])
    out = (out - (out[inner].mean(0) if inner.any() else 0)) / recipe.scale
    inner &= np.linalg.norm(out, axis=2) < recipe.clip
    return out * inner[..., None], inner, truth & inner


def test_chain_against_loops(spark):
    pick = np.random.default_rng(8)
    recipe, rows, want = Recipe(size=12, neighbours=6, ratio=1.5, scale=2.0, clip=2.0), [], {}
    for k, (h, w) in enumerate([(9, 7), (6, 14), (8, 8), (3, 3), (5, 5), (4, 4)]):
        v, u = np.mgrid[:h, :w].astype(float)
        xyz = np.stack([u + 1, v + 1, 3 + 0.1 * pick.normal(size=(h, w))], 2)
        if k < 3:
            xyz[0], xyz[:, -1] = 0, 0
            xyz[h // 2, w // 2] = [9, 9, 40]  # a flying pixel
            xyz[1, 1] = np.nan
        if k == 4:
            xyz[:] = 0
        if k == 5:
            xyz[1:] = 0  # four points, fewer than neighbours: no outliers, and nothing left after the erosion
        gt = pick.random((h, w)) < 0.3
        rows.append((k, *(xyz[..., c].ravel().tolist() for c in range(3)), None if k == 3 else gt.ravel().tolist(), h, w, f"name {k}", [True]))
        want[k] = plain(xyz, np.zeros_like(gt) if k == 3 else gt, recipe)
    df = spark.createDataFrame(rows, "vec_id long, x array<double>, y array<double>, z array<double>, gt array<boolean>, h int, w int, name string, valid array<boolean>").repartition(3)
    found = preprocess.preprocess(df, recipe)
    got = {r.vec_id: r for r in found.collect()}
    assert set(got) == set(want) and all(r.name == f"name {k}" and (r.h, r.w) == (12, 12) for k, r in got.items())
    for k, (xyz, ok, truth) in want.items():
        assert np.array(got[k].valid).reshape(12, 12).tolist() == ok.tolist() and np.array(got[k]["gt"]).reshape(12, 12).tolist() == truth.tolist(), k
        assert np.allclose(np.stack([got[k].x, got[k].y, got[k].z], 1).reshape(12, 12, 3), xyz, atol=1e-9)
    assert any(ok.any() for _, ok, _ in want.values()) and not any(got[4].valid)
    assert preprocess.preprocess(df.limit(0), recipe).count() == 0


@pytest.mark.parametrize("n, size", [(1, 4), (2, 5), (9, 3), (4, 4)])
def test_resize_of_a_ramp(n, size):
    grid = np.arange(n, dtype=float)[:, None].repeat(n, 1)
    assert (preprocess.resized(grid, size, True).min() >= 0) and (preprocess.resized(grid, size, True).max() <= n - 1)
    assert n != size or np.allclose(preprocess.resized(grid, size, True), grid)
