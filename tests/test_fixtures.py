"""Operators on small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.functions import calibration, ranking
from gridlight.operators import bank, bootstrap, control, deploy, regions, report, tracking, training
from gridlight.streaming import episodes


def one(df):
    return df.first()


@pytest.mark.parametrize(("scores", "labels", "want"), [([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), ([-0.1, -0.2, -0.8, -0.9], [0, 0, 1, 1], 0.0), ([0.5, 0.5], [0, 1], 0.5), ([0.1, 0.2], [1, 1], None)])
def test_auroc(spark, scores, labels, want):
    df = spark.createDataFrame([(1, float(s), b) for s, b in zip(scores, labels)], "k int, score double, label int")
    assert one(ranking.auroc(df, ["k"])).auroc == want


def test_auroc_by_type_pools_the_normals(spark):
    rows = [("good", 0.1, 0), ("good", 0.2, 0), ("hole", 0.8, 1), ("hole", 0.9, 1), ("crack", 0.15, 1)]
    got = {r.defect: (r.n, r.auroc) for r in ranking.auroc_by_type(spark.createDataFrame(rows, "defect string, score double, label int"), "defect").collect()}
    assert got == {"hole": (2, 1.0), "crack": (1, 0.5)}


def test_ece(spark):
    same = spark.createDataFrame([(float(t), t, True) for t in (0, 1, 1, 0)], "p double, target int, valid boolean")
    assert one(calibration.ece(same)).ece == pytest.approx(0, abs=1e-6)
    sure = spark.createDataFrame([(0.95, int(i < 9), True) for i in range(1024)], "p double, target int, valid boolean")
    assert one(calibration.ece(sure)).ece > 0.8
    assert one(calibration.ece(same.withColumn("valid", F.lit(False)))).ece is None
    assert {r.bin for r in calibration.bins(spark.createDataFrame([(1.0, 1, True), (0.0, 0, True)], "p double, target int, valid boolean"), 15).collect()} == {0, 14}


def scan_rows(spark, images):
    rows = [(k, 1, a.ravel().tolist(), m.ravel().tolist(), [True] * a.size, *a.shape) for k, (a, m) in enumerate(images)]
    return spark.createDataFrame(rows, "vec_id long, category int, amap array<double>, mask array<boolean>, valid array<boolean>, h int, w int")


def test_au_pro_of_a_perfect_and_a_random_map(spark):
    rng = np.random.default_rng(0)
    mask = np.zeros((32, 32), bool)
    mask[14:18, 14:18] = True
    assert one(regions.au_pro(scan_rows(spark, [(mask + 1e-3 * rng.random((32, 32)), mask) for _ in range(6)]), ["category"])).au_pro > 0.97
    assert 0.05 < one(regions.au_pro(scan_rows(spark, [(rng.random((32, 32)), mask) for _ in range(12)]), ["category"])).au_pro < 0.3
    assert regions.au_pro(scan_rows(spark, [(rng.random((4, 4)), np.zeros((4, 4), bool))]), ["category"]).count() == 0


def test_labels_join_diagonals_and_long_snakes():
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]], bool)
    assert np.unique(regions.label_grid(mask)).tolist() == [-1, 0]
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert (regions.label_grid(snake)[snake] == 0).all()


def test_topk_score(spark):
    a = np.zeros((10, 10))
    a[0, :5] = 4
    s = scan_rows(spark, [(a, a > 9)])
    assert one(regions.topk_score(s, 5)).score == 4.0
    assert one(regions.topk_score(s.withColumn("valid", F.transform("valid", lambda _: F.lit(False))), 5)).score == 0.0


def test_nearest_breaks_ties_by_id_among_many_equal_vectors(spark):
    bank_rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300, 0, -1)] + [(0, [9.0, 9.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 2.5]), (8, None)], "vec_id long, embedding array<double>")
    found = bank.nearest(queries, bank_rows, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.bank_id, r.dist) for r in found] == [(7, 1, 0.5), (7, 2, 0.5), (7, 3, 0.5)]
    assert bank.nearest(queries, bank_rows.limit(0)).count() == 0


def test_nearest_equals_direct_distances_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(37, 16)), rng.normal(size=(64, 16))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = np.sqrt(((q[:, None] - b[None]) ** 2).sum(2)).min(1)
    for most in (200_000, 10):
        monkeypatch.setattr(bank, "BANK_BLOCK", most)
        monkeypatch.setattr(bank, "QUERY_BLOCK", 3 * most)
        got = {r.vec_id: r.dist for r in bank.nearest(frame(q), frame(b)).collect()}
        assert np.allclose([got[i] for i in range(37)], want, atol=1e-9)


def test_coreset_covers_both_clusters(spark):
    rows = [(i, 1, [float(100 * (i >= 20)) + i * 1e-3]) for i in range(40)]
    picked = [r.point for r in bank.farthest_points(spark.createDataFrame(rows, "vec_id long, c int, embedding array<double>"), ["c"], 4).collect()]
    assert any(p < 20 for p in picked) and any(p >= 20 for p in picked)


def test_bootstrap_of_equal_arms_has_no_delta(spark):
    rows = spark.createDataFrame([(i, "a", float(i % 7), i % 2) for i in range(40)], "id long, category string, score double, label int")
    d = bootstrap.drawn(bootstrap.positions(rows, ["category"], ["id"]), 50)
    assert d.groupBy("draw").agg(F.sum("times").alias("n")).where("n != 40").count() == 0
    a = bootstrap.auroc_of(d, ["draw", "category"])
    lo, hi = a.agg(*bootstrap.interval(a, "auroc")).first()
    assert 0 <= lo <= one(ranking.auroc(rows, ["category"])).auroc <= hi <= 1


def test_rollouts(spark):
    steps = spark.createDataFrame([(1, t, 1.0, t == 2, t == 1) for t in range(5)] + [(2, t, 1.0, False, False) for t in range(9)], "ep int, t long, reward double, done boolean, success boolean")
    cut = control.truncate(steps, ["ep"], 5)
    eps = {r.ep: r for r in control.episodes(cut, ["ep"]).collect()}
    assert (eps[1].n_steps, eps[1].ret, eps[1].first_done, eps[1].success) == (3, 3.0, 3, True)
    assert (eps[2].n_steps, eps[2].first_done, eps[2].success) == (5, None, False)


def test_chunks_fill_the_tail(spark):
    rows = spark.createDataFrame([(1, t, a) for t, a in enumerate(("a", "b", "c"))], "ep int, t int, action string")
    got = [r.chunk for r in control.chunks(rows, ["ep"], "action", 4).orderBy("t").collect()]
    assert got == [list("abcc"), list("bccc"), list("cccc")]


def test_gain_estimate(spark):
    df = spark.createDataFrame([(0.03, 1.0), (0.05, 1.0), (0.05, 0.0)], "dv double, a double")
    assert [round(r[0], 9) for r in df.select(control.estimated_gain(F.col("dv"), F.col("a"), 0.05)).collect()] == [0.6, 1.0, 1.0]


def test_fit_rules(spark):
    m = deploy.matrix(*deploy.documents(spark)).cache()
    assert m.count() == 112
    cell = lambda d, a, p, o: m.where((F.col("detector") == d) & (F.col("accelerator") == a) & (F.col("precision") == p) & (F.col("onnx") == F.lit(o))).first().verdict
    assert cell("convvae", "rpi5_cortex_a76", "fp32", True) == "full-ondevice"
    assert cell("btf", "hailo_8", "int8", True) == "backbone+host-tail"
    assert cell("convvae", "hailo_8", "int8", False) == "does-not-deploy"
    assert cell("convvae", "coral_edgetpu", "int8", True) == "streams-offchip"
    assert 0.33 < one(deploy.bank_cost(spark.createDataFrame([("x", 10000, 256, 1)], "name string, n long, c long, patches long"))).disk_int8_mb < 0.35


def test_verdicts(spark):
    rows = [("a", "Conv", "NPU"), ("b", "Conv", "NPU"), ("b", "TopK", "CPU"), ("c", "Conv", "CPU")]
    got = {r.graph: r.verdict for r in deploy.op_verdict(spark.createDataFrame(rows, "graph string, op string, target string")).collect()}
    assert got == {"a": "native", "b": "host_tail", "c": "host_fragmented(Conv)"}


def test_mesh_text(spark):
    v, f = deploy.parse_obj(deploy.log_lines(spark, "v 4 -1 0.5\nv 2 2 2\nv 0 0 9\nv 1 1 1\nf 4/1/1 2/2/2 3/3/3"))
    assert v.count() == 4 and one(f).face == [3, 1, 2]


def test_strict_invariants_raise(spark):
    nan = float("nan")
    rows = [(1, 0.7, 0.7, 0.72, 0.8, None, -1.0, 2.0, 0.1, 0.5, 0.6), (2, 0.7, 0.69, 0.6, 0.8, 0.1, 0.0, 1.5, 0.2, 0.5, 0.6), (3, None, nan, 0.6, 0.5, 0.1, 0.0, 1.0, None, 0.5, 0.6)]
    bad = spark.createDataFrame(rows, "k int, mean double, point double, lo double, hi double, ece double, least double, most double, delta double, a double, b double")
    found = tracking.violations(bad, "k")
    assert sorted((r.k, r.rule) for r in found.collect()) == [(1, "bracket"), (2, "aggregate"), (2, "range"), (2, "reconciles")]
    with pytest.raises(Exception, match="invariants"):
        tracking.require(found).collect()


def test_unknown_reference_raises(spark):
    texts = spark.createDataFrame([(1, "x <!--r:a.b-->1<!--/r--> y")], "id int, text string")
    refs = spark.createDataFrame([("a.b", 0.5)], "ref string, value double")
    assert one(report.inline(texts, refs)).text == "x <!--r:a.b-->0.500<!--/r--> y"
    with pytest.raises(Exception, match="unknown reference"):
        report.inline(texts, refs.where("ref = 'c'")).collect()


def test_ema_begins_with_the_first_value(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0)], "k string, t int, loss double")
    assert one(training.ema(rows, ["k"], ["t"], "loss", 0.5)).ema == 0.5
    w = training.curriculum(training.ema(rows, ["k"], ["t"], "loss", 0.5), spark.createDataFrame([("a",), ("b",)], "k string"), "k")
    assert {round(r.weight, 6) for r in w.collect()} == {0.5}


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    live = episodes.read(spark, f"file://{tmp_path}/in", events._jdf.schema().toDDL(), 1)
    query = episodes.hourly(live).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    want = episodes.hourly(events.withColumn("ts", F.col("ts").cast("timestamp")))
    columns = ["window", "event_type", "n"]
    assert spark.table("hours").select(columns).exceptAll(want.select(columns)).isEmpty() and spark.table("hours").count() == want.count()


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in p], *map(float, p)) for i, p in enumerate(x)], "vec_id long, embedding array<double>, x double, y double, z double")


def test_plane_with_the_most_inliers_is_found(spark):
    rng = np.random.default_rng(4)
    flat = np.c_[rng.uniform(-1, 1, (200, 2)), np.zeros(200)]
    found = bank.plane_inliers(cloud(spark, np.r_[flat, rng.uniform(1, 2, (30, 3))]), 24, 1e-6).collect()
    assert [r.inliers for r in found] == [200]
    assert bank.plane_inliers(cloud(spark, flat).limit(0), 3, 1.0).count() == 0
    assert bank.plane_inliers(cloud(spark, flat[:1].repeat(5, 0)), 3, 1.0).count() == 0  # one point makes no plane


def test_surface_variation_against_loops(spark):
    x = np.random.default_rng(6).normal(size=(40, 3)) * [1, 1, 0.2]
    got = {r.vec_id: r.variation for r in bank.surface_variation(cloud(spark, x), 8).collect()}
    for i in range(40):
        near = x[np.argsort(np.linalg.norm(x - x[i], axis=1), kind="stable")[:8]]
        values = np.linalg.eigvalsh(np.cov(near.T))
        assert got[i] == pytest.approx(values[0] / values.sum())


def test_reconstruction_errors_against_singular_vectors(spark, data):
    from gridlight.plans.cloud import pca_reconstruction

    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([list(r.embedding) for r in rows], float)
    x -= x.mean(0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:8]
    want = (x**2).sum(1) - ((x @ axes.T) ** 2).sum(1)
    got = {r.vec_id: r.error for r in pca_reconstruction(spark, data).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=1e-5)
