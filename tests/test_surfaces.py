"""Surfaces against a dense solve, a sampled sphere and planted sheets."""

import numpy as np
import pytest

from gridlight.operators import clouds, surfaces


def sphere(n, seed=0):
    """Points of the unit sphere, evenly spread."""
    i = np.arange(n) + 0.5
    z, turn = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, i, *map(float, p), *map(float, n)) for i, (k, p, n) in enumerate(rows)], "key string, vec_id long, x double, y double, z double, nx double, ny double, nz double")


def euler(vertices, faces):
    edges = {frozenset(e) for f in faces for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
    return len(vertices) - len(edges) + len(faces)


def volume(vertices, faces):
    return sum(np.dot(vertices[a], np.cross(vertices[b], vertices[c])) for a, b, c in faces) / 6


def parts(found, key):
    vertices, faces = (df.where(f"key = '{key}'").collect() for df in found)
    return {r.vertex: np.array([r.x, r.y, r.z]) for r in vertices}, [(r.a, r.b, r.c) for r in faces]


def test_field_is_the_dense_solution(spark):
    rng = np.random.default_rng(1)
    size, hold, places = 0.25, 0.7, rng.uniform(-0.6, 0.6, (12, 3))
    normals = rng.normal(size=(12, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    sums = {}
    for p, n in zip(places, normals):
        for node in np.ndindex(14, 14, 14):
            at = np.array(node) - 7
            near = 1 - ((at * size - p) ** 2).sum() / (2 * size) ** 2
            if near > 1e-6:
                w = near * near
                s = sums.setdefault(tuple(at.tolist()), np.zeros(5))
                s += [w, w * ((at * size - p) @ n), *(w * n)]
    nodes = sorted(sums)
    place = {n: i for i, n in enumerate(nodes)}
    a, b = np.zeros((len(nodes),) * 2), np.zeros(len(nodes))
    for n, i in place.items():
        own = sums[n]
        a[i, i] += hold * own[0]
        b[i] += hold * own[1]
        for axis in range(3):
            m = tuple(c + (d == axis) for d, c in enumerate(n))
            if m in place:
                j, step = place[m], size * (own[2 + axis] / own[0] + sums[m][2 + axis] / sums[m][0]) / 2
                a[[i, j], [i, j]] += 1
                a[[i, j], [j, i]] -= 1
                b[i] -= step
                b[j] += step
    want = np.linalg.solve(a, b)
    faced = frame(spark, [("k", p, n) for p, n in zip(places, normals)])
    found = surfaces.solved(surfaces.splat(faced, "key", size), "key", size, hold, 1e-6)
    rows = found.select(*(surfaces.coordinate(found["node"], i).alias("ijk"[i]) for i in range(3)), "weight", "f").collect()
    assert sorted((r.i, r.j, r.k) for r in rows) == nodes
    for r in rows:
        assert r.weight == pytest.approx(sums[r.i, r.j, r.k][0])
        assert r.f == pytest.approx(want[place[r.i, r.j, r.k]], abs=1e-4)


def test_sphere_is_closed_and_near(spark):
    places = sphere(1500)
    rows = [("one", p, p) for p in places] + [("two", p * 0.5 + [3, 0, 0], p) for p in places]
    odd = [(None, places[0], places[0])]
    found = surfaces.surface(frame(spark, rows + odd), "key", 0.12)
    assert surfaces.open_edges(found[1], "key").isEmpty()
    for key, radius, centre in (("one", 1.0, np.zeros(3)), ("two", 0.5, np.array([3.0, 0, 0]))):
        vertices, faces = parts(found, key)
        assert max(abs(np.linalg.norm(v - centre) - radius) for v in vertices.values()) < 0.12
        assert euler(vertices, faces) == 2
        assert volume({k: v - centre for k, v in vertices.items()}, faces) == pytest.approx(4 / 3 * np.pi * radius**3, rel=0.1)
    assert found[0].where("key is null").isEmpty()


def test_normals_found_from_the_points(spark):
    df = frame(spark, [("one", p, p) for p in sphere(900)]).drop("nx", "ny", "nz")
    faced = clouds.normals(df, clouds.neighbour_table(df, "key", 10), "key")  # towards the origin: the outside is within
    found = surfaces.surface(faced, "key", 0.15)
    vertices, faces = parts(found, "one")
    assert surfaces.open_edges(found[1], "key").isEmpty() and euler(vertices, faces) == 2
    assert volume(vertices, faces) == pytest.approx(-4 / 3 * np.pi, rel=0.1)
    turned = surfaces.towards(faced, (0.0, 0.0, -1.0)).collect()
    assert all(r.nz <= 0 for r in turned)


def test_trim_takes_what_few_points_support(spark):
    grid = [("k", np.array([i * 0.05, j * 0.05, 0.01]), np.array([0, 0, 1.0])) for i in range(20) for j in range(20)]
    lone = [("k", np.array([3.0, 3.0, 0.01]), np.array([0, 0, 1.0]))]
    whole = surfaces.surface(frame(spark, grid + lone), "key", 0.1)[0]
    assert whole.where("x > 2").count() > 0
    vertices, faces = surfaces.surface(frame(spark, grid + lone), "key", 0.1, 0.3)
    assert vertices.where("x > 2").count() == 0 and vertices.where("x between 0.3 and 0.7 and y between 0.3 and 0.7").count() > 0
    assert vertices.where("abs(z - 0.01) > 1e-6").count() == 0
    named = {r.vertex for r in vertices.collect()}
    assert named == {v for r in faces.collect() for v in (r.a, r.b, r.c)}


def test_odd_rows(spark):
    empty = surfaces.surface(frame(spark, []), "key", 0.1)
    assert empty[0].isEmpty() and empty[1].isEmpty()
    twice = [("k", np.zeros(3), np.array([0, 0, 1.0]))] * 2 + [("k", [float("nan"), 0, 0], [0, 0, 1.0]), ("k", [float("inf"), 0, 0], [0, 0, 1.0])]
    vertices, _ = surfaces.surface(frame(spark, twice), "key", 0.1)
    assert 0 < vertices.count() < 60
    with pytest.raises(Exception, match="too many cells"):
        surfaces.surface(frame(spark, [("k", [1e9, 0, 0], [0, 0, 1.0])]), "key", 0.1)
