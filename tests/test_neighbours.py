"""Pruned nearest neighbours against all pairs, by key; what they compare; and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.operators import neighbours


def plain(queries, bank, k):
    """{(key, id): [(bank_id, dist)]} by measuring every pair of one key."""
    out = {}
    for key, i, x in queries:
        if x is not None:
            d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for other, j, y in bank if other == key and y is not None)
            if d:
                out[key, i] = [(j, v) for v, j in d[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(a, i, x) for a, i, x in rows], "cloud string, vec_id long, embedding array<double>").repartition(3)


def check(found, want):
    got = {}
    for r in found.orderBy("cloud", "vec_id", "rank").collect():
        got.setdefault((r.cloud, r.vec_id), []).append((r.bank_id, r.dist))
    assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items()}
    assert all(np.allclose([d for _, d in got[k]], [d for _, d in want[k]], atol=1e-12) for k in want)


@pytest.mark.parametrize("k, settings", [(1, neighbours.Settings()), (5, neighbours.Settings(ratio=3, group=40, queries=30, few=0)), (3, neighbours.Settings(most=2, group=25, least_groups=1, few=20))])
def test_nearest_against_all_pairs(spark, k, settings):
    pick = np.random.default_rng(k)
    rows = lambda cloud, n, low: [(cloud, low + i, (pick.normal(size=3) + 4 * pick.integers(0, 3)).tolist()) for i in range(n)]
    bank = rows("a", 150, 0) + rows("b", 3, 0) + [("a", 900 + i, [1.0, 2.0, 3.0]) for i in range(60)] + [("c", 1, None), ("e", 5, [0.0, 0.0, 0.0])]
    queries = rows("a", 80, 1000) + rows("b", 10, 1000) + rows("d", 2, 0) + [("a", 2000, [1.0, 2.0, 3.0]), ("a", 2001, None), ("c", 2, [0.0] * 3), ("e", 1, [1.0] * 3), ("a", 2002, [99.0, 0.0, 0.0])]
    found, cost = neighbours.nearest(frame(spark, queries), frame(spark, bank), k, ["cloud"], settings)
    check(found, plain(queries, bank, k))
    assert cost.count() == len(plain(queries, bank, k))


def test_nearest_without_keys_and_without_rows(spark):
    pick = np.random.default_rng(2)
    rows = [("x", i, pick.normal(size=8).tolist()) for i in range(300)]
    df = frame(spark, rows).drop("cloud")
    found, _ = neighbours.nearest(df.where("vec_id % 3 = 0"), df, 4)
    check(found.withColumn("cloud", F.lit("x")), plain([r for r in rows if r[1] % 3 == 0], rows, 4))
    assert neighbours.nearest(df, df.limit(0), 4)[0].count() == 0 and neighbours.nearest(df.limit(0), df, 4)[0].count() == 0


def test_pruning_of_vectors_with_structure(spark):
    """32 dimensions in 60 groups: under a tenth of all pairs are measured, and the rows are those of all pairs."""
    pick = np.random.default_rng(9)
    centres = pick.normal(size=(60, 32))
    rows = [("x", i, (centres[i % 60] + 0.05 * pick.normal(size=32)).tolist()) for i in range(3000)]
    df = frame(spark, rows).drop("cloud")
    queries = df.where("vec_id < 300")
    found, cost = neighbours.nearest(queries, df, 3)
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(2))
    got = np.full((300, 3), -1)
    for r in found.collect():
        got[r.vec_id, r.rank - 1] = r.bank_id
    assert (got == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
    assert cost.agg(F.sum("compared")).first()[0] < 0.1 * 300 * 3000


def plain_histograms(x, k):
    """Feature histograms of one cloud by loops over points, neighbours and angles."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = [[j for j in np.lexsort((np.arange(n), d[i])) if j != i][:k] for i in range(n)]
    normal = []
    for i in range(n):
        p = x[[i, *near[i]]]
        p = p - p.mean(0)
        v = np.linalg.eigh(p.T @ p)[1][:, 0]
        normal.append(-v if v @ x[i] > 0 else v)
    own = np.zeros((n, 33))
    for i in range(n):
        for j in near[i]:
            w = (x[j] - x[i]) / max(d[i, j], 1e-12)
            u = normal[i]
            v = np.cross(w, u)
            v = v / max(np.linalg.norm(v), 1e-12)
            angles = v @ normal[j], u @ w, np.arctan2(np.cross(u, v) @ normal[j], u @ normal[j]) / np.pi
            for a, value in enumerate(angles):
                own[i, 11 * a + min(max(int((value + 1) / 2 * 11), 0), 10)] += 100 / len(near[i])
    full = np.array([own[i] + sum((own[j] / max(d[i, j], 1e-12) for j in near[i]), np.zeros(33)) / max(1, len(near[i])) for i in range(n)]).reshape(n, 3, 11)
    return (100 * full / np.maximum(full.sum(2, keepdims=True), 1e-12)).reshape(n, 33)


def clouds_of(spark, parts):
    return spark.createDataFrame([(c, i, *map(float, p)) for c, x in parts.items() for i, p in enumerate(x)], "cloud string, vec_id long, x double, y double, z double").repartition(3)


def test_feature_histograms_against_loops(spark, monkeypatch):
    """Clouds of any size, a single point and equal points among them; the larger is in several groups of cells."""
    from gridlight.operators import clouds

    monkeypatch.setattr(neighbours.nearest, "__defaults__", (1, None, neighbours.Settings(few=100)))
    pick = np.random.default_rng(9)
    parts = {"large": pick.normal(size=(260, 3)) + [0, 0, 5], "small": pick.normal(size=(5, 3)) + 3, "pair": pick.normal(size=(2, 3)), "alone": np.ones((1, 3))}
    got = {(r.cloud, r.vec_id): r.fpfh for r in clouds.descriptors(clouds_of(spark, parts), "cloud", 10).collect()}
    assert len(got) == sum(map(len, parts.values()))
    for c, x in parts.items():
        want = plain_histograms(x, 10)
        assert np.allclose([got[c, i] for i in range(len(x))], want, atol=1e-6), c
    assert clouds.descriptors(clouds_of(spark, parts).limit(0), "cloud", 10).count() == 0


def test_feature_histograms_do_not_change_under_motions(spark):
    from gridlight.operators import clouds

    x = np.random.default_rng(9).normal(size=(60, 3))
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    rows = clouds.descriptors(clouds_of(spark, {"a": x, "b": x @ turn.T}), "cloud", 10).orderBy("cloud", "vec_id").collect()
    a, b = (np.array([r.fpfh for r in rows if r.cloud == c]) for c in "ab")
    assert a.shape == b.shape == (60, 33) and np.isfinite(a).all() and np.median(np.abs(a - b)) < 1e-6


def test_outliers_of_each_cloud(spark):
    """Each cloud has limits of its own; one that is too small is kept whole; alone and equal points don't fail."""
    from gridlight.operators import bank

    pick = np.random.default_rng(4)
    parts = {"a": np.r_[pick.normal(size=(80, 3)), [[30, 30, 30]]], "b": np.r_[10 * pick.normal(size=(50, 3)), [[300, 0, 0]]], "few": np.array([[0, 0, 0], [0, 0, 1], [9, 9, 9]]), "alone": np.zeros((1, 3))}
    points = clouds_of(spark, parts).withColumn("embedding", F.array("x", "y", "z"))
    got = {(r.cloud, r.vec_id): (r.mean_dist, r.kept) for r in bank.outlier_filter(points, 6, 2.0, ["cloud"]).collect()}
    for c, x in parts.items():
        mean = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :6].mean(1)
        assert np.allclose([got[c, i][0] for i in range(len(x))], mean)
        assert [got[c, i][1] for i in range(len(x))] == [len(x) <= 6 or m < mean.mean() + 2 * mean.std(ddof=1) for m in mean]
    assert not got["a", 80][1] and not got["b", 50][1]
    assert bank.surface_variation(points.where("cloud = 'alone'"), 5, ["cloud"]).first().variation == 0.0


@pytest.mark.parametrize("k, share", [(1, 0.1), (20, 0.3)])
def test_pruning_of_the_cloud(spark, k, share):
    """What is measured of all pairs of the given points (2,000 at sf0.1); it falls with the root of their number."""
    from gridlight.plans.banks import _cloud

    points = _cloud(spark, "/root/testdata/sf0.1").select("vec_id", "embedding")
    n = points.count()
    assert neighbours.nearest(points, points, k)[1].agg(F.sum("compared")).first()[0] < share * n * n
