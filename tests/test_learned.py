"""Fitted methods against numpy: least squares and chunk policies, shrunk covariances, planes and objects, detectors, the triad's pixel model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.operators import clouds, detectors, harness, moments, policies, triad
from tests.test_harness import some_scans


def test_least_squares_with_many_outputs(spark):
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 6)) * [1, 10, 1e-3, 1, 5, 1] + [0, 100, 0, 3, 0, 0]
    y = x @ pick.normal(size=(6, 3)) + pick.normal(size=(400, 3)) + 7
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))] + [(900, None, [1.0] * 3), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0] * 3), (902, [float("inf")] * 6, [0.0] * 3)], "k long, x array<double>, y array<double>").repartition(5)
    model = moments.least_squares(df, "x", "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(400)], y, rcond=None)[0]
    assert model.rows == 400 and np.allclose(model.weights, want, rtol=1e-6, atol=1e-8)
    got = {r.k: r.out for r in moments.predicted(df, model, "x", "out").collect()}
    assert np.allclose([got[k] for k in range(400)], np.c_[x, np.ones(400)] @ want, atol=1e-6) and got[900] is None and got[901] is None
    assert moments.least_squares(df.limit(0), "x", "y").rows == 0


def test_chunk_policy_against_loops(spark):
    """Chunks of each episode with the tail held, one least-squares fit, and the averages of overlapping predictions, with and without decay."""
    pick = np.random.default_rng(2)
    episodes = {e: (pick.normal(size=(n, 3)), pick.normal(size=n)) for e, n in enumerate((1, 2, 7, 30))}
    rows = [(e, t, obs[t].tolist(), float(a[t])) for e, (obs, a) in episodes.items() for t in range(len(a))]
    df = spark.createDataFrame(rows, "e int, t long, obs array<double>, a double").repartition(3)
    k = 4
    x = np.concatenate([obs for obs, _ in episodes.values()])
    y = np.array([[a[min(t + j, len(a) - 1)] for j in range(k)] for _, a in episodes.values() for t in range(len(a))])
    w = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    model = policies.clone_chunks(df, ["e"], "obs", "a", k)
    assert np.allclose(model.weights, w, atol=1e-9)
    for decay in (0.0, 0.5):
        got = {(r.e, r.t): r.action for r in policies.act(df, model, ["e"], "obs", k, decay).collect()}
        for e, (obs, a) in episodes.items():
            p = np.c_[obs, np.ones(len(obs))] @ w
            for t in range(len(a)):
                ages = range(min(k, t + 1))
                assert got[e, t] == pytest.approx(np.average([p[t - j, j] for j in ages], weights=[np.exp(-decay * j) for j in ages]))


def ledoit_wolf(x):
    """The published formula, by sums over the centred rows."""
    n, d = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (n * n * d)
    share = min(beta, delta) / delta
    return x.mean(0), (1 - share) * s + share * mu * np.eye(d)


def test_distances_in_full_dimension(spark, data):
    """64 dimensions by category, far from the origin, with fewer rows than dimensions in some."""
    rows = [(r.vec_id, r.label, (np.array(r.embedding, float) + 1000).tolist()) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, category int, embedding array<double>").repartition(4)
    odd = df.where("vec_id % 2 = 1").unionByName(spark.createDataFrame([(100001, rows[0][1], None), (100003, rows[0][1], [1.0]), (100005, 999, [0.0] * 64)], df.schema))
    got = {r.vec_id: r.dist for r in moments.mahalanobis(df.where("vec_id % 2 = 0"), odd, ["category"], part=7).collect()}
    for c in {r[1] for r in rows}:
        train = np.array([v for i, k, v in rows if k == c and i % 2 == 0])
        mean, cov = ledoit_wolf(train)
        for i, k, v in rows:
            if k == c and i % 2 == 1:
                z = np.array(v) - mean
                assert got.pop(i) == pytest.approx(np.sqrt(z @ np.linalg.solve(cov, z)), rel=1e-6)
    assert got == {100001: None, 100003: None}  # a category without train vectors has no rows


def scene(seed, centre):
    """A table top, a large and a small cluster above it, and stray points."""
    pick = np.random.default_rng(seed)
    top = np.c_[pick.uniform(-2, 2, (300, 2)), pick.normal(0, 0.001, 300)]
    turn = np.linalg.qr(pick.normal(size=(3, 3)))[0]
    large, small = pick.normal(0, 0.05, (80, 3)) + [0.5, 0.5, 0.6], pick.normal(0, 0.05, (30, 3)) + [-1, -1, 0.6]
    return np.r_[top, large, small, [[0, 0, 3], [1, -1, 2.0]]] @ turn + centre


def test_object_off_the_plane(spark):
    scenes = {"a": scene(3, 0), "b": scene(4, 5)}
    rows = [(c, 1000 * k + i, *map(float, p)) for k, (c, x) in enumerate(scenes.items()) for i, p in enumerate(x)]
    rows += [("tiny", 9000 + i, float(i), 0.0, 0.0) for i in range(4)] + [("tiny", 9010, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scene string, vec_id long, x double, y double, z double").repartition(3)
    found = {r.scene: r for r in clouds.planes(df.where("x is not null"), "scene", 40, 0.01).collect()}
    assert set(found) == {"a", "b"}  # points on a line make no plane
    for c, x in scenes.items():
        p = x[:300] - x[:300].mean(0)
        normal = np.linalg.svd(p)[2][2]
        r = found[c]
        assert abs(normal @ [r.a, r.b, r.c]) == pytest.approx(1, abs=1e-4) and r.n == 300
    got = {}
    for r in clouds.isolated(df, "scene", 0.01, 0.15, 5, 40).collect():
        got.setdefault(r.scene, set()).add(r.vec_id)
    for k, c in enumerate(scenes):
        own = {i - 1000 * k for i in got[c]}
        assert own <= set(range(300, 380)) and len(own) >= 75
    assert got["tiny"] == {9000, 9001, 9002, 9003}  # neither a plane nor a cluster: all of it
    assert clouds.isolated(df.limit(0), "scene", 0.01, 0.1, 5).count() == 0


def with_channels(spark, n=24):
    rows, df = some_scans(spark, n)
    df = df.withColumnRenamed("amap", "value")
    place = lambda f: F.transform("value", lambda v, i: f(v, i).cast("double"))
    return rows, triad.channels(df.withColumns({"x": place(lambda v, i: i % 5), "y": place(lambda v, i: F.floor(i / 5)), "z": place(lambda v, i: v + 2)}))


def plain_channels(row):
    v = np.array(row[4]).reshape(5, 5)
    pad = np.pad(v, 1)
    mean = sum(pad[i : i + 5, j : j + 5] for i in range(3) for j in range(3)) / 9
    return np.stack([v.ravel(), mean.ravel(), np.abs(v - mean).ravel()], 1)


def test_bank_method_against_all_pairs(spark):
    rows, df = with_channels(spark)
    train, test = df.where("vec_id < 12"), df.where("vec_id >= 12")
    method = detectors.Bank()
    got = {r.vec_id: r.amap for r in method.score(method.fit(train), test).collect()}
    assert len(got) == 12
    for r in rows[12:]:
        bank = np.concatenate([plain_channels(t)[np.array(t[6])] for t in rows[:12] if t[1] == r[1]])
        x = plain_channels(r)
        want = np.sqrt(((x[:, None] - bank[None]) ** 2).sum(2)).min(1) * np.array(r[6])
        assert np.allclose(got[r[0]], want)


def test_two_level_sample(spark):
    rows = [(c, 10 * k + i, 100 * (10 * k + i) + p) for k, c in enumerate("ab") for i in range(3) for p in range(40 if i else 5)]
    df = spark.createDataFrame(rows, "category string, vec_id long, point long").repartition(4)
    kept = detectors.thinned(df, 20, 0.5).collect()
    assert {c: sum(r.category == c for r in kept) for c in "ab"} == {"a": 22, "b": 22}  # 5 + 20 + 20 of each, and half of these
    assert sorted(map(tuple, kept)) == sorted(map(tuple, detectors.thinned(df.repartition(7), 20, 0.5).collect()))
    assert detectors.thinned(df, None, 1.0).count() == len(rows)


def test_fused_maps_against_numpy(spark):
    class Fixed:
        def __init__(self, f):
            self.f = f

        def fit(self, train):
            return None

        def score(self, state, test):
            return test.withColumn("amap", F.transform("value", self.f))

    rows, df = with_channels(spark)
    got = {r.vec_id: r.amap for r in detectors.Fused(Fixed(lambda v: v * 3), Fixed(lambda v: v * v), 0.7).score((None, None), df).collect()}
    for c in "ab":
        own = [r for r in rows if r[1] == c]
        v, ok = np.array([r[4] for r in own]), np.array([r[6] for r in own])
        z = lambda m: (m - m[ok].mean()) / (m[ok].std() + 1e-9)
        want = (0.7 * z(3 * v) + 0.3 * z(v * v)) * ok
        assert np.allclose([got[r[0]] for r in own], want, atol=1e-9)


def test_registered_methods_from_fit_to_report(spark):
    assert {"bank", "histograms", "fused"} <= set(harness.METHODS)
    _, df = with_channels(spark)
    scores, report = detectors.evaluated("fused", df.where("vec_id < 12"), df.where("vec_id >= 12"), 5)
    assert scores.columns == harness.SCORES and scores.count() == 12
    assert {(r.part, r.name) for r in report.collect()} == {("category", "a"), ("category", "b"), ("defect", "t0"), ("defect", "t1"), ("mean", "MEAN")}


def test_pixel_model_against_newton_steps(spark):
    rows, df = with_channels(spark)
    model = triad.fit(df, steps=6)
    for c in "ab":
        own = [r for r in rows if r[1] == c]
        ok = np.concatenate([np.array(r[6]) for r in own])
        x, y = np.concatenate([plain_channels(r) for r in own])[ok], np.concatenate([np.array(r[5]) for r in own])[ok].astype(float)
        z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
        w = np.zeros(4)
        for _ in range(6):
            q = 1 / (1 + np.exp(-z @ w))
            w = w + np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + np.eye(4), z.T @ (y - q) - w)
        assert np.allclose(model.weights[c], w, atol=1e-8)
        assert np.allclose(model.stats[c][0], x.mean(0)) and np.allclose(model.stats[c][1], x.std(0))
    # adapted to scans of three times the contrast, the model gives what it gave before
    scaled = triad.channels(df.withColumn("value", F.transform("value", lambda v: v * 3 + 1)))
    a = {r.vec_id: r.amap for r in triad.score(df.where("vec_id < 99"), triad.PixelModel(model.weights, model.stats)).collect()}
    b = triad.adapted(model, scaled)
    assert all(np.allclose(b.stats[c][1][0], 3 * model.stats[c][1][0]) for c in "ab") and len(a) == len(rows)


def test_synthetic_defects_stay_on_the_object(spark):
    rows, df = with_channels(spark)
    made = {r.vec_id: r for r in triad.synthetic(df.where("label = 0")).collect()}
    assert set(made) == {r[0] for r in rows if not r[3]}
    for r in rows:
        if not r[3]:
            m = made[r[0]]
            changed = ~np.isclose(m.value, r[4])
            assert (changed == np.array(m["mask"])).all() and not (changed & ~np.array(r[6])).any() and m.label == 1


def test_triad_halves_and_deltas(spark):
    _, df = with_channels(spark, 40)
    calibration, evaluation = triad.split(df)
    count = lambda d: {(r.category, r.label): r["count"] for r in d.groupBy("category", "label").count().collect()}
    a, b = count(calibration), count(evaluation)
    assert set(a) == set(b) and all(b[k] - a[k] in (0, 1) for k in a) and calibration.join(evaluation, "vec_id").count() == 0
    arms = triad.arms(df)
    found = {r.name: r for r in triad.deltas(arms, {"gap": ("synth", "real"), "none": ("real", "real")}, 20).collect()}
    assert found["none"].delta == found["none"].lo == found["none"].hi == 0
    gap = found["gap"]
    assert gap.delta == pytest.approx(gap.second - gap.first) and gap.lo <= gap.hi
    assert gap.second > gap.first - 0.05  # real masks teach at least about as much
