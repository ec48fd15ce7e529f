"""Embedding whitening (operator 12) against whole-number sums and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import whitening


def plain(vectors, components=32):
    """(exact integers, deviations, covariance, eigenvalues) of a list of vectors, by whole numbers of any size."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    spread = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[n * r[k] - sums[k] for k in range(d)] for r in x], object)
    v = np.array([[int(e) / n**3 for e in row] for row in centred.T @ centred])
    return centred, spread, v, np.linalg.eigvalsh(v)[::-1][:components]


def check(rows, ids, vectors, tolerance=1e-9):
    centred, spread, v, values = plain(vectors)
    n, kept = len(vectors), min(32, len(vectors[0]))
    assert len(rows) == n * kept
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by, key=repr) == sorted(ids, key=repr)
    w = np.array([[by[i][c].whitened for c in range(1, kept + 1)] for i in ids])
    z = (centred / n).astype(float)
    for k in range(kept):
        # the component's axis is what the whitened values give back, and is an eigenvector of the covariance
        axis = z.T @ w[:, k] / n / math.sqrt(values[k])
        assert np.linalg.norm(axis) == pytest.approx(1, abs=1e-6)
        assert np.abs(v @ axis - values[k] * axis).max() < 1e-6 * values[0]
        assert np.allclose(w[:, k], z @ axis / math.sqrt(values[k]), atol=1e-6)
    for i, s in zip(ids, spread):
        assert {(r.n, r.deviation) for r in by[i].values()} == {(n, s)}
        assert [by[i][c].explained for c in range(1, kept + 1)] == pytest.approx((values / np.trace(v)).tolist(), rel=1e-9)
    cov = np.cov(w.T, bias=True).reshape(kept, kept)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(cov - np.eye(kept)).max(), abs=tolerance)


def test_embeddings_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    rows = whitening.op12_residue_whitening(spark, data).collect()
    check(rows, [r.vec_id for r in table], [r.embedding for r in table])
    assert rows[0].identity_error < 1e-8


def test_odd_rows(spark):
    pick = np.random.default_rng(12)
    vectors = [pick.normal(size=6).tolist() for _ in range(40)]
    good = [(k, v) for k, v in enumerate(vectors)] + [(None, [0.0] * 6), (7, [1e6, -2.5, 0.0, 1.0, 2.0, 3.0]), (7, vectors[7])]
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (53, [float("nan")] * 6), (54, [float("inf")] * 6), (55, [1e300] * 6), (56, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 0, 1) for i, v in good + bad], "vec_id long, embedding array<double>, n int, component int").repartition(4)
    model = whitening.fit(docs.select(F.col("embedding").alias("vector")))
    rows = whitening.whiten(docs, model).collect()
    kept = sorted(good, key=repr)
    assert len(rows) == 6 * len(kept)
    _, spread, _, values = plain([v for _, v in kept])
    assert sorted((repr(r.vec_id), r.deviation) for r in rows if r.component == 1) == sorted((repr(i), s) for (i, _), s in zip(kept, spread))
    assert model.values.tolist() == pytest.approx(values.tolist(), rel=1e-9) and model.identity_error < 1e-6


def test_no_rows_one_row_and_equal_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = lambda df: whitening.whiten(df, whitening.fit(df.select(F.col("embedding").alias("vector")))).collect()
    assert fitted(frame([])) == [] and fitted(frame([(1, None)])) == []
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = fitted(frame(rows))
        assert len(found) == 2 * len(rows) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(0, 0.0, 0.0, 0.0)}


def test_zero_eigenvalue(spark):
    pick = np.random.default_rng(2)
    rows = [(k, [a, a, b]) for k, (a, b) in enumerate(pick.normal(size=(200, 2)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df.select(F.col("embedding").alias("vector")))
    assert model.rank == 2 and model.identity_error < 1e-10
    assert {r.whitened for r in whitening.whiten(df, model).collect() if r.component == 3} == {0.0}


def test_scatter_is_exact_beyond_doubles(spark):
    pick = np.random.default_rng(5)
    big = (pick.integers(-(1 << 40), 1 << 40, (9000, 3))).tolist()
    df = spark.createDataFrame([([float(c) for c in v],) for v in big], "vector array<double>").repartition(3)
    settings = whitening.Settings()
    x = [[64 * c + 1_000_000 for c in v] for v in big]
    n, sums, least, most = whitening.moments(df, settings)
    assert (n, sums, least, most) == (9000, [sum(c) for c in zip(*x)], [min(c) for c in zip(*x)], [max(c) for c in zip(*x)])
    centre = [s // n for s in sums]
    want = [[sum((r[i] - centre[i]) * (r[j] - centre[j]) for r in x) for j in range(3)] for i in range(3)]
    assert whitening.scatter(df, centre, whitening.primes(6), settings) == want


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [2.0**54]), (2, [0.0]), (3, [0.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, whitening.fit(df.select(F.col("embedding").alias("vector")))).collect()
    assert [r.deviation for r in rows] == [None, None, None] and all(math.isfinite(r.whitened) for r in rows)


def test_primes():
    found = whitening.primes(5)
    assert all(all(p % k for k in range(2, math.isqrt(p) + 1)) for p in found) and found == sorted(found, reverse=True) and max(found) < 1 << 21
