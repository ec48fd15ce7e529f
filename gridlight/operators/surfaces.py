"""Surfaces from points with normals: a signed distance on a sparse table of lattice nodes, faces by cube, trimmed by density.

A node is one number: its three lattice coordinates, twenty bits each. Points give every node within two cells the weighted
distance along their normals; the distances are then made to agree with each other and with the normals along the lattice's
edges, a system of equations that is solved by rounds in which every node hears its six neighbours (one exchange a round). Nodes far
from all points don't exist, so the table grows with the surface, not with the volume, and no task holds a cloud.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.sources.shared import written

BITS, HALF = 20, 1 << 19
#: What a step along x, y and z adds to a node's number.
STEPS = (1 << 2 * BITS, 1 << BITS, 1)
#: How far a point reaches, in cells.
REACH = 2


def _node(i: Column, j: Column, k: Column) -> Column:
    return (i + HALF) * STEPS[0] + (j + HALF) * STEPS[1] + (k + HALF)


def coordinate(node: Column, axis: int) -> Column:
    """The lattice coordinate of a node along an axis."""
    return F.shiftright(node, (2 - axis) * BITS).bitwiseAND((1 << BITS) - 1) - HALF


def towards(faced: DataFrame, direction: tuple[float, float, float]) -> DataFrame:
    """``faced`` (.., nx, ny, nz) with every normal turned to the side of ``direction``; those square to it stay."""
    flip = F.col("nx") * direction[0] + F.col("ny") * direction[1] + F.col("nz") * direction[2] < 0
    return faced.withColumns({c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in ("nx", "ny", "nz")})


def splat(faced: DataFrame, key: str, size: float) -> DataFrame:
    """(key, node, weight, dist, nx, ny, nz): every node within two cells of a point, with means weighted by nearness.

    ``dist`` is how far the node lies outside, along the points' normals. Rows with a null or non-finite number are left
    out; coordinates beyond half a million cells from the origin are an error.
    """
    numbers = [*"xyz", "nx", "ny", "nz"]
    fine = faced.select(key, *(F.col(c).cast("double").alias(c) for c in numbers))
    fine = fine.where(F.col(key).isNotNull()).where(" and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in numbers))
    far = F.greatest(*(F.abs(F.col(c)) for c in "xyz")) > (HALF - 8) * size
    cells = fine.withColumns({f"c{c}": F.when(far, F.raise_error(F.lit("a point lies too many cells from the origin"))).otherwise(F.floor(F.col(c) / size)) for c in "xyz"})
    around = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(o, "ijk"))) for o in np.ndindex(*(2 * REACH,) * 3)))
    rows = cells.withColumn("o", F.explode(around)).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"o.{n}") - (REACH - 1) for c, n in zip("xyz", "ijk")})
    off = {c: F.col(f"c{c}") * size - F.col(c) for c in "xyz"}
    near = 1 - sum((v * v for v in off.values()), F.lit(0.0)) / (REACH * size) ** 2
    along = sum((off[c] * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    w = F.col("w")
    rows = rows.select(key, _node(F.col("cx"), F.col("cy"), F.col("cz")).alias("node"), (near * near).alias("w"), along.alias("d"), near.alias("near"), "nx", "ny", "nz").where("near > 1e-6")
    sums = rows.groupBy(key, "node").agg(F.sum(w).alias("weight"), *(F.sum(w * F.col(c)).alias(c) for c in ("d", "nx", "ny", "nz")))
    return sums.select(key, "node", "weight", (F.col("d") / F.col("weight")).alias("dist"), *((F.col(c) / F.col("weight")).alias(c) for c in ("nx", "ny", "nz")))


def _sent(nodes: DataFrame, key: str, keep: list[str], say: list[str]) -> DataFrame:
    """Each node's row, and what it says to its six neighbours: rows (key, node, keep.., say.., axis, sign), null of axis in its own."""
    own = F.struct(F.lit(None).cast("int").alias("axis"), F.lit(0).alias("sign"), F.lit(0).cast("long").alias("add"))
    others = [F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign"), F.lit(s * STEPS[a]).cast("long").alias("add")) for a in range(3) for s in (-1, 1)]
    rows = nodes.withColumn("to", F.explode(F.array(own, *others)))
    mine = F.col("to.axis").isNull()
    return rows.select(key, (F.col("node") + F.col("to.add")).alias("node"), *(F.when(mine, F.col(c)).alias(c) for c in keep), *(F.when(~mine, F.col(c)).alias(f"_{c}") for c in say), "to.axis", "to.sign")


def solved(nodes: DataFrame, key: str, size: float, hold: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """(key, node, weight, f): the function that is nearest to the nodes' distances, by weight and ``hold``, and whose steps along the lattice are nearest to those of the normals.

    The least-squares equations are solved by conjugate gradients, scaled by their diagonal, until no node is further than
    ``tolerance`` cells from what its neighbours and points ask of it. A round is one exchange and one row of sums; its
    table is written, so that a lost executor costs one round. Clouds share the rounds, so one may be solved better than it needs.
    """
    # a neighbour that says it lies one step up the axis is one step of the mean normal away
    sent = _sent(nodes, key, ["weight", "dist", "nx", "ny", "nz"], ["nx", "ny", "nz"])
    theirs = F.element_at(F.array("_nx", "_ny", "_nz"), F.col("axis") + 1)
    sides = [F.sum(F.when(F.col("axis") == a, F.col("sign"))).alias(f"s{a}") for a in range(3)]
    got = sent.groupBy(key, "node").agg(
        *(F.max(c).alias(c) for c in ("weight", "dist", "nx", "ny", "nz")), F.count("axis").alias("degree"), F.sum(F.col("sign") * theirs).alias("said"), *sides
    ).where("weight is not null")
    own = sum((F.coalesce(F.col(f"s{a}"), F.lit(0)) * F.col(n) for a, n in enumerate(("nx", "ny", "nz"))), F.lit(0.0))
    fixed = hold * F.col("weight") * F.col("dist") + size / 2 * (F.coalesce("said", F.lit(0.0)) + own)
    total = hold * F.col("weight") + F.col("degree")
    start = written(got.select(key, "node", "weight", total.alias("total"), fixed.alias("fixed"), F.col("dist").alias("f")), "field")
    # what the equations leave at the start; then each round moves f along p, a mix of what is left and the last way
    left = F.col("fixed") - F.col("image")
    state = _applied(start, key, ["weight", "total", "fixed", "f"], "f").withColumn("r", left).select(key, "node", "weight", "total", "f", "r", (F.col("r") / F.col("total")).alias("p"))
    state = written(state, "field")
    while True:
        state = written(_applied(state, key, ["weight", "total", "f", "r", "p"], "p"), "field")
        scaled = lambda u, v: F.coalesce(F.sum(F.col(u) * F.col(v) / F.col("total")), F.lit(0.0))
        worst, rr, ri, ii, pi = state.agg(F.coalesce(F.max(F.abs(F.col("r") / F.col("total"))), F.lit(0.0)), scaled("r", "r"), scaled("r", "image"), scaled("image", "image"), F.coalesce(F.sum(F.col("p") * F.col("image")), F.lit(0.0))).first()
        if worst <= tolerance * size or pi <= 0:
            return state.select(key, "node", "weight", "f")
        step = rr / pi
        mix = max(rr - 2 * step * ri + step * step * ii, 0.0) / rr
        r = F.col("r") - step * F.col("image")
        state = state.select(key, "node", "weight", "total", (F.col("f") + step * F.col("p")).alias("f"), r.alias("r"), (r / F.col("total") + mix * F.col("p")).alias("p"))


def _applied(state: DataFrame, key: str, keep: list[str], column: str) -> DataFrame:
    """``state`` with image: the equations' left side for ``column``, each node's total times its own less the sum of its neighbours'."""
    heard = _sent(state, key, keep, [column]).groupBy(key, "node").agg(*(F.max(c).alias(c) for c in keep), F.sum(f"_{column}").alias("said"))
    return heard.where("weight is not null").select(key, "node", *keep, (F.col("total") * F.col(column) - F.coalesce("said", F.lit(0.0))).alias("image"))


#: The eight corners of a cube, and its six tetrahedra: the ways from the first corner to the last along the axes.
CORNERS = [tuple(c >> 2 - a & 1 for a in range(3)) for c in range(8)]
TETRAHEDRA = [[0, 4 >> p[0], (4 >> p[0]) + (4 >> p[1]), 7] for p in permutations(range(3))]


def _triangles(node: np.ndarray, f: np.ndarray, weight: np.ndarray, size: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vertex, place, density) of the triangles of cubes with corner values (n, 8): three vertices each, their normals where the values grow."""
    base = np.stack([(node >> (2 - a) * BITS & (1 << BITS) - 1) - HALF for a in range(3)], 1)
    corners = np.array(CORNERS)
    adds = corners @ np.array(STEPS)

    def cut(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vertex on the edge of two corners, the same from every cube that has the edge."""
        a, b = np.minimum(low, high), np.maximum(low, high)  # along a way of axes the smaller number is the nearer corner
        fa, fb = f[rows, a], f[rows, b]
        t = fa / (fa - fb)
        place = (base[rows] + corners[a] + t[:, None] * (corners[b] - corners[a])) * size
        return (node[rows] + adds[a]) * 8 + (b - a), place, weight[rows, a] + t * (weight[rows, b] - weight[rows, a])

    for tet in np.array(TETRAHEDRA):
        inside = f[:, tet] < 0
        count = inside.sum(1)
        order = np.argsort(~inside, axis=1, kind="stable")  # inner corners first
        for n, faces in ((1, [((0, 1), (0, 2), (0, 3))]), (3, [((0, 3), (1, 3), (2, 3))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))])):
            rows = np.flatnonzero(count == n)
            if not len(rows):
                continue
            own = tet[order[rows]]
            out = corners[own[:, n:]].mean(1) - corners[own[:, :n]].mean(1)
            for face in faces:
                cuts = [cut(rows, own[:, lo], own[:, hi]) for lo, hi in face]
                vertex, place, density = (np.stack([c[i] for c in cuts], 1) for i in range(3))
                # the corners' order, not the area, decides, so that triangles without area are turned as well
                ends = np.stack([corners[own[:, hi]] + corners[own[:, lo]] for lo, hi in face], 1)
                turn = (np.cross(ends[:, 1] - ends[:, 0], ends[:, 2] - ends[:, 0]) * out).sum(1) < 0
                for part in (vertex, place, density):
                    part[turn] = part[turn][:, ::-1]
                yield rows, vertex, place, density


def extracted(field: DataFrame, key: str, size: float) -> DataFrame:
    """(key, face, at, vertex, x, y, z, density): three rows a triangle of the surface where f is 0, at 0 to 2 around the outside.

    Every cube whose eight corners exist and lie on both sides gives the triangles of its six tetrahedra. A vertex is named
    by the edge that it lies on, so that cubes share vertices without comparing places.
    """
    kind = dict(field.dtypes)[key]
    corners = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(-sum(o * s for o, s in zip(c, STEPS))).cast("long").alias("add")) for n, c in enumerate(CORNERS)))
    rows = field.withColumn("c", F.explode(corners)).select(key, (F.col("node") + F.col("c.add")).alias("node"), F.col("c.n").alias("n"), "f", "weight")
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}")
    cubes = rows.groupBy(key, "node").agg(F.count("*").alias("n"), F.min("f").alias("low"), F.max("f").alias("high"), *(at(c, n) for c in ("f", "weight") for n in range(8)))
    cubes = cubes.where("n = 8 and low < 0 and high >= 0").drop("n", "low", "high")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            table = lambda c: frame[[f"{c}{n}" for n in range(8)]].to_numpy(float)
            node, key_of, seen = frame["node"].to_numpy(np.int64), frame[key].to_numpy(), np.zeros(len(frame), np.int64)
            for rows, vertex, place, density in _triangles(node, table("f"), table("weight"), size):
                flat = lambda v: v.reshape(-1)
                number = seen[rows].astype("int32")
                seen[rows] += 1
                yield pd.DataFrame({
                    key: np.repeat(key_of[rows], 3), "cube": np.repeat(node[rows], 3), "face": np.repeat(number, 3), "at": np.tile(np.arange(3, dtype="int32"), len(rows)),
                    "vertex": flat(vertex), "x": flat(place[:, :, 0]), "y": flat(place[:, :, 1]), "z": flat(place[:, :, 2]), "density": flat(density),
                })

    return cubes.mapInPandas(run, f"{key} {kind}, cube long, face int, at int, vertex long, x double, y double, z double, density double")


def surface(faced: DataFrame, key: str, size: float, trim: float = 0.0, hold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of each cloud (key, x, y, z, nx, ny, nz): (key, vertex, x, y, z, density) and (key, a, b, c), outwards as the normals point.

    ``size`` is the cell's edge and wants about a point a cell. The share ``trim`` of a cloud's vertices with the least
    density (points near a vertex, by weight) goes, with all faces that have one of them, and vertices of no face go too; the quantile
    is that of a mergeable sketch, off by at most a hundred-thousandth of the ranks. Where points surround a body the
    mesh is closed before trimming; an open sheet ends two cells beyond its points. Rows with a null key, coordinate or
    normal are left out, repeated points weigh more, and clouds without a point give nothing.
    """
    field = solved(splat(faced, key, size), key, size, hold)
    corners = written(extracted(field, key, size), "corners")
    vertices = corners.groupBy(key, "vertex").agg(*(F.max(c).alias(c) for c in ("x", "y", "z", "density")))
    names = [F.max(F.when(F.col("at") == n, F.col("vertex"))).alias(c) for n, c in enumerate("abc")]
    faces = corners.groupBy(key, "cube", "face").agg(F.min("density").alias("least"), *names)
    if trim > 0:
        limits = vertices.groupBy(key).agg(F.percentile_approx("density", trim, 100_000).alias("limit"))
        faces = faces.join(limits, key).where("least >= limit")
    faces = written(faces.select(key, *"abc"), "faces")
    used = faces.select(key, F.explode(F.array(*"abc")).alias("vertex")).distinct()
    return vertices.join(used, [key, "vertex"], "left_semi"), faces


def open_edges(faces: DataFrame, key: str) -> DataFrame:
    """(key, u, v, n): edges that don't belong to exactly two faces running opposite ways; none for a closed, oriented mesh."""
    ways = F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")))
    edges = faces.select(key, F.explode(ways).alias("e")).select(key, F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v"), F.when(F.col("e.p") < F.col("e.q"), 1).otherwise(-1).alias("way"))
    return edges.groupBy(key, "u", "v").agg(F.count("*").alias("n"), F.sum("way").alias("way")).where("n != 2 or way != 0").drop("way")
