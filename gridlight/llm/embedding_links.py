"""Embedding near-duplicates (operator 9): randomised-rotation binary codes with correction factors.

A unit vector is rotated by a random orthogonal matrix and kept as the signs of its coordinates, with
the factor that makes inner-product estimates from signs unbiased (the RaBitQ estimator), and as its
turned coordinates in bytes, for its side of an estimate as the query. Tables of sign bits along
directions of their own find candidate pairs. Only these codes are exchanged for them: the estimate and
its confidence bounds drop pairs that are certainly below the threshold, and the full vectors are
fetched for what is left, which is recomputed exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import components, table, written
from gridlight.llm.near_duplicates import _forest, components_sql


@dataclass(frozen=True)
class Settings:
    """Cosine threshold, expected share of linked pairs at it that no table finds, confidence (standard deviations) and block size."""

    cosine: float = 0.95
    miss: float = 0.002
    sigmas: float = 6.0
    block: int = 1024
    sparse: int = 4  # pairs for each member of two blocks up to which they are listed; beyond, the blocks' full vectors are compared
    seed: int = 9

    def tables(self, rows: int) -> tuple[int, int]:
        """(bits of a table's key, tables) for so many distinct vectors: buckets stay small while the recall is kept."""
        bits = min(40, max(8, math.ceil(math.log2(max(1, rows) / 16)) if rows > 16 else 8))
        agree = 1 - math.acos(self.cosine) / math.pi  # probability that one bit of two linked vectors is equal
        return bits, math.ceil(math.log(self.miss) / math.log1p(-(agree**bits)))


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits, correction factor) of unit rows: the factor is <code, vector>, the code being the signs over sqrt(size)."""
    turned = unit @ turn
    return turned > 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def in_bytes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed bytes, step) of turned rows: coordinates are at most half a step off."""
    step = np.maximum(np.abs(turned).max(1), 1e-300) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def bounds(query: np.ndarray, bits: np.ndarray, factor: np.ndarray, sigmas: float, step: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates, lower, upper confidence bounds) of the inner products of turned ``query`` rows with coded unit vectors.

    The estimate is <code, query> / factor. Its error comes from the part of the code orthogonal to the
    vector, in a direction that the rotation makes uniform in size - 1 dimensions: its deviation is
    k * sqrt(1 - c * c) for an inner product c, and the bounds are the c that lie ``sigmas`` such deviations off
    the estimate, on either side. ``step`` is that of queries in bytes, whose largest possible error is added.
    """
    size = query.shape[1]
    signs = np.where(bits, 1.0, -1.0) / math.sqrt(size)
    guess = query @ signs.T / factor
    k2 = sigmas**2 * np.maximum(0, 1 - factor**2) / factor**2 / max(1, size - 1)
    wide = np.sqrt(k2 * np.maximum(0, 1 + k2 - guess**2))
    slack = np.asarray(step).reshape(-1, 1) * (math.sqrt(size) / 2) / factor
    low, high = (guess - wide) / (1 + k2) - slack, (guess + wide) / (1 + k2) + slack
    beyond = guess**2 > 1 + k2  # more than any inner product allows: the nearest possible
    return guess, np.where(beyond, np.minimum(low, np.sign(guess)), low), np.where(beyond, np.maximum(high, np.sign(guess)), high)


def least_estimate(factor: np.ndarray, size: int, settings: Settings) -> np.ndarray:
    """The estimate from which on the upper bound of ``bounds`` reaches the threshold."""
    k = settings.sigmas * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, size - 1)) / factor
    return settings.cosine - k * math.sqrt(max(0.0, 1 - settings.cosine**2))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, digest, unit) of ``rows`` (vec_id, embedding): the packed unit vector in double precision and a digest of its direction.

    Both are null for a vector that is null, empty, zero, or has null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([math.nan if c is None else c for c in v or ()], float)
                top = float(np.abs(x).max()) if len(x) else 0.0
                if not (math.isfinite(top) and top > 0):
                    digests.append(None)
                    units.append(None)
                    continue
                x = x / top
                packed = (x / math.sqrt(x @ x) + 0.0).tobytes()
                digests.append(xxhash.xxh3_128_digest(packed))
                units.append(packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "digest", "unit"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, digest binary, unit binary")


def table_keys(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) keys: signs along each table's own random directions, packed, so that all bits are independent.

    Directions are normal draws, so two vectors agree in a bit with the probability that ``Settings.tables``
    counts on, whatever their number of components.
    """
    pick = np.random.default_rng(seed + 1)
    keys = np.zeros((len(unit), tables), np.int64)
    for t in range(tables):
        keys[:, t] = (unit @ pick.normal(size=(unit.shape[1], bits)) > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return keys


def groups(count: int) -> Column:
    """The group that compares a dealt row: several buckets of one block share one, so that small ones cost little; two blocks of a crowded bucket, or one with itself, have their own."""
    return F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("t", "key"), F.lit(max(64, count // 256)))).otherwise(F.xxhash64("t", "key", "i", "j"))


CELL = ["t", "key", "i", "j"]


def _cells(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray | None]]:
    """(rows of two blocks, places of the first block's, places of the second's or None for one block with itself) of a group."""
    for (_, _, i, j), cell in rows.sort_values([*CELL, "node"]).groupby(CELL, sort=False):
        mine = cell["mine"].to_numpy()
        yield cell, np.flatnonzero(mine == i), None if i == j else np.flatnonzero(mine == j)


def _fresh(a: np.ndarray, b: np.ndarray, t: np.ndarray | int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Whether no table before ``t`` has both vectors of a pair in one bucket: a pair counts in the first of its tables."""
    same = table_keys(a, bits, tables, seed) == table_keys(b, bits, tables, seed)
    return same.argmax(1) == t


def links(nodes: DataFrame, settings: Settings) -> DataFrame:
    """For distinct unit vectors (node, weight, unit): rows (a, b, n): with a = b, ``n`` more rows linked to node a; else an edge.

    A bucket of a table is dealt into blocks, and every two blocks are sifted in one task from their
    codes. What the bounds leave is listed as pairs while it is a few for each member; the full
    vectors of listed pairs are fetched and compared. Two blocks with more are compared in one task from
    their full vectors, which gives each member's count of links and a spanning forest, so a crowded
    bucket is neither one task nor a list of its pairs. A pair that shares several buckets counts in
    the first table that has both.
    """
    held = settings
    count = nodes.count()
    bits, tables = held.tables(count)

    def by_size(packed: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, unit rows) of packed vectors, those of one length together."""
        sizes = np.array([len(p) for p in packed])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield at, np.frombuffer(b"".join(packed[k] for k in at.tolist()), float).reshape(len(at), -1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = (batch.column(c).to_numpy() for c in range(2))
            for at, unit in by_size(batch.column(2).to_pylist()):
                turn = rotation(unit.shape[1], held.seed)
                (signs, factor), (query, step) = codes(unit, turn), in_bytes(unit @ turn)
                keys = table_keys(unit, bits, tables, held.seed) ^ (unit.shape[1] << 47)
                packed = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (np.packbits(signs, axis=1), query, keys)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(weights[at]), packed[0], pa.array(factor), packed[1], pa.array(step), packed[2]], names=["node", "weight", "code", "factor", "query", "step", "keys"])

    coded = written(nodes.select("node", "weight", "unit").mapInArrow(code, "node long, weight long, code binary, factor double, query binary, step double, keys binary"), "codes")
    every = F.array(*[F.struct(F.lit(k).alias("t"), F.xxhash64(F.substring("keys", 8 * k + 1, 8)).alias("key")) for k in range(tables)])
    places = coded.select("node", F.explode(every).alias("at")).select("at.t", "at.key", "node")
    sizes = places.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(settings.block)).cast("int")
    crowded = places.join(sizes, ["t", "key"]).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
    dealt = crowded.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "key", "node", "mine", "blocks", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
    dealt = written(dealt, "dealt")

    def sift(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, rows in rows.groupby(rows["query"].map(len)):
            rows = rows.sort_values([*CELL, "node"], ignore_index=True)
            cells, node, mine, step = rows[CELL].to_numpy(), rows["node"].to_numpy(), rows["mine"].to_numpy(), rows["step"].to_numpy()
            query = (np.frombuffer(b"".join(rows["query"]), np.int8).reshape(len(rows), size) * step[:, None]).astype(np.float32)
            bits = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1, count=size)
            signs = ((bits * 2.0 - 1) / math.sqrt(size)).astype(np.float32)
            # the upper bound reaches the threshold from this product of code and query on; queries are up to half a step off
            need = (least_estimate(rows["factor"].to_numpy(), size, held) * rows["factor"].to_numpy() - 1e-5).astype(np.float32)
            off = (step * (math.sqrt(size) / 2)).astype(np.float32)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if cells[low, 2] == cells[low, 3]:
                    possible = query[low:high] @ signs[low:high].T + off[low:high, None] >= need[low:high]
                    a, b = np.nonzero(np.triu(possible, 1))
                    a, b = a + low, b + low
                else:
                    left, right = (low + np.flatnonzero(mine[low:high] == cells[low, k]) for k in (2, 3))
                    a, b = np.nonzero(query[left] @ signs[right].T + off[left, None] >= need[right])
                    a, b = left[a], right[b]
                if len(a) > held.sparse * (high - low):
                    out.append(pd.DataFrame({**dict(zip(CELL, cells[low].tolist())), "a": pd.array([None], "Int64"), "b": pd.array([None], "Int64")}))
                elif len(a):
                    x, y = node[a], node[b]
                    out.append((cells[low, 0], np.minimum(x, y), np.maximum(x, y)))
        dense = [x for x in out if isinstance(x, pd.DataFrame)]
        pairs = [x for x in out if not isinstance(x, pd.DataFrame)]
        if pairs:
            t = np.repeat([x[0] for x in pairs], [len(x[1]) for x in pairs])
            dense.append(pd.DataFrame({"t": t, "key": 0, "i": 0, "j": 0, "a": pd.array(np.concatenate([x[1] for x in pairs]), "Int64"), "b": pd.array(np.concatenate([x[2] for x in pairs]), "Int64")}))
        return pd.concat(dense) if dense else pd.DataFrame({c: [] for c in (*CELL, "a", "b")})

    sent = dealt.join(coded.select("node", "code", "factor", "query", "step"), "node")
    sifted = written(sent.withColumn("group", groups(count)).groupBy("group").applyInPandas(sift, "t int, key long, i int, j int, a long, b long"), "sifted")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, t, wa, wb = (batch.column(c).to_numpy() for c in range(5))
            x, y = (batch.column(c).to_pylist() for c in (5, 6))
            for at, first in by_size(x):
                second = np.frombuffer(b"".join(y[k] for k in at.tolist()), float).reshape(len(at), -1)
                near = (first * second).sum(1) >= held.cosine
                at, first, second = at[near], first[near], second[near]
                at = at[_fresh(first, second, t[at], bits, tables, held.seed)] if len(at) else at
                zero = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((a[at], b[at], a[at]), (a[at], b[at], b[at]), (wb[at], wa[at], zero))], names=["a", "b", "n"])

    side = lambda c, w, u: nodes.select(F.col("node").alias(c), F.col("weight").alias(w), F.col("unit").alias(u))
    pairs = sifted.where("a is not null").groupBy("a", "b").agg(F.min("t").alias("t"))
    full = pairs.join(side("a", "wa", "x"), "a").join(side("b", "wb", "y"), "b").select("a", "b", "t", "wa", "wb", "x", "y")
    listed = full.mapInArrow(decide, "a long, b long, n long")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cell, left, right in _cells(rows):
            packed, ids, weight, t = cell["unit"].tolist(), cell["node"].to_numpy(), cell["weight"].to_numpy(), int(cell["t"].iloc[0])
            for own, unit in by_size(packed):
                ours = np.flatnonzero(np.isin(own, left))
                theirs = ours if right is None else np.flatnonzero(np.isin(own, right))
                turn = rotation(unit.shape[1], held.seed)
                signs, factor = codes(unit[theirs], turn)
                possible = bounds(unit[ours] @ turn, signs, factor, held.sigmas)[2] >= held.cosine
                a, b = np.nonzero(np.triu(possible, 1) if right is None else possible)
                a, b = ours[a], theirs[b]
                near = np.concatenate([(unit[a[k : k + 50_000]] * unit[b[k : k + 50_000]]).sum(1) >= held.cosine for k in range(0, len(a), 50_000)]) if len(a) else np.zeros(0, bool)
                a, b = a[near], b[near]
                if not len(a):
                    continue
                keys = table_keys(unit, bits, tables, held.seed)
                earlier = np.zeros(len(a), bool)
                for k in range(t):
                    earlier |= keys[a, k] == keys[b, k]
                a, b = a[~earlier], b[~earlier]
                nodes_of, weights = ids[own], weight[own]
                more = np.bincount(a, weights[b], len(own)) + np.bincount(b, weights[a], len(own))
                some = np.flatnonzero(more)
                kept = np.array(_forest(np.stack([a, b], 1), len(own)), np.int64).reshape(-1, 2)
                out.append(np.stack([nodes_of[some], nodes_of[some], more[some].astype(np.int64)], 1))
                out.append(np.stack([nodes_of[kept[:, 0]], nodes_of[kept[:, 1]], np.zeros(len(kept), np.int64)], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3), np.int64), columns=["a", "b", "n"])

    dense = sifted.where("a is null").select(*CELL)
    whole = dealt.join(dense, CELL, "left_semi").join(nodes, "node").select(*CELL, "node", "weight", "mine", "unit")
    return listed.unionByName(whole.groupBy(*CELL).applyInPandas(compare, "a long, b long, n long"))


def near_duplicates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``rows`` (vec_id, embedding): one row per row with a vec_id.

    Vectors of one direction are one node with a weight, so copies cost nothing. A vector that is
    null, zero, or has null or non-finite components links with nothing; vectors of different
    lengths don't link. Rows with a null vec_id are left out; rows that repeat a vec_id count as
    other vectors, each with its own links, and a component_id is the smallest vec_id of what is reached.
    """
    made = written(vectors(rows.where("vec_id is not null")), "units")
    same = made.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    # a node is a direction, numbered once and written; the smallest vec_id that has it stands beside
    nodes = written(same.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "weight", "unit"), "nodes")
    found = written(links(nodes, settings), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    joined = components(found.where("n = 0 and a != b").select("a", "b"))
    every = nodes.select("digest", "node", "least", "weight").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = every.groupBy("component").agg(F.min("least").alias("component_id"))
    every = every.select("digest", "component", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")).join(smallest, "component")
    linked = made.where("digest is not null").join(every, "digest").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = made.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision for every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES = {
    "op9_rotation_codes": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) >= 0.95e0 * a.norm * b.norm),
{components_sql('embeddings', 'vec_id')},
l AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON comp.node = vec_id LEFT JOIN l ON l.node = vec_id""",
}
