"""Embedding whitening (operator 12) from a residue-number scatter.

Entries become integers. Each partition multiplies its rows by themselves modulo several primes, small
enough that a product of matrices in doubles is exact; the sums of the residues over all partitions give
the integer scatter by the Chinese remainder theorem, so the covariance is exact, whatever the number
of rows and the order in which they are summed. One eigendecomposition in doubles follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import table, written

#: Residues are below 2**20 in size, so products of 2**12 rows sum up to less than 2**53.
PRIME_BITS, GEMM_ROWS = 21, 4096
#: Entries from here on don't become a long; their rows count as not finite.
LARGEST = 2.0**56


@dataclass(frozen=True)
class Settings:
    """An entry c becomes floor(scale * c) + shift; at most ``components`` of the largest eigenvalues are given."""

    scale: int = 64
    shift: int = 1_000_000
    components: int = 32


@dataclass
class Whitening:
    """The fit: n rows, exact sums of each dimension, eigenvectors as columns and eigenvalues, both by falling eigenvalue."""

    n: int
    sums: list[int]
    largest: int  # of |n * x - sums|, an upper bound
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    settings: Settings
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is more than rounding leaves of zero."""
        return int((self.values > self.size * 2.0**-52 * max(self.values.max(initial=0.0), 0.0)).sum())


def primes(count: int, below: int = 1 << PRIME_BITS) -> list[int]:
    """The ``count`` largest primes below ``below``."""
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for k in range(2, math.isqrt(below) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    return np.flatnonzero(sieve)[::-1][:count].tolist()


def integers(column: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, (rows, dimensions) integers) of the vectors of a batch, those of one length together.

    Left out are null and empty vectors and those with entries that are null, not finite or beyond a long.
    """
    lists = pa.array(column.to_pylist(), pa.list_(pa.float64())) if column.offset else column
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)  # nulls become not a number
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = flat[offsets[at][:, None] + np.arange(size)]
        fits = (np.abs(rows) < LARGEST).all(1)
        if fits.any():
            yield at[fits], np.floor(settings.scale * rows[fits]).astype(np.int64) + settings.shift


def _summed(rows: DataFrame, keys: list[str], values: list[str], kinds: list[str]) -> DataFrame:
    """Arrays of one length added up place by place, for each key: sums, minima or maxima, combined before the shuffle."""
    each = rows.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("at", "v"))
    return each.groupBy(*keys, "at").agg(*(getattr(F, k)(F.col(f"v.{v}")).alias(v) for v, k in zip(values, kinds)))


def moments(vectors: DataFrame, settings: Settings) -> tuple[int, list[int], list[int], list[int]]:
    """(n, sums, smallest and largest integer of each dimension) of the vectors of the most frequent length (of equal ones the longer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch.column(0), settings):
                own = [len(x), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0)]
                old = found.get(x.shape[1])
                found[x.shape[1]] = own if old is None else [old[0] + own[0], old[1] + own[1], old[2] + own[2], np.minimum(old[3], own[3]), np.maximum(old[4], own[4])]
        for size, (n, *arrays) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([n]), *(pa.array([a.tolist()], pa.list_(pa.int64())) for a in arrays)], names=["size", "n", "high", "low", "least", "most"])

    parts = written(vectors.select("vector").mapInArrow(run, "size long, n long, high array<long>, low array<long>, least array<long>, most array<long>"), "moments")
    chosen = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if not chosen:
        return 0, [], [], []
    own = parts.where(F.col("size") == chosen["size"]).withColumns({c: F.col(c).cast("array<decimal(38,0)>") for c in ("high", "low")})
    rows = _summed(own, [], ["high", "low", "least", "most"], ["sum", "sum", "min", "max"]).orderBy("at").collect()  # a row for each dimension
    return int(chosen.n), [(int(r.high) << 32) + int(r.low) for r in rows], [r.least for r in rows], [r.most for r in rows]


def scatter(vectors: DataFrame, centre: list[int], moduli: list[int], settings: Settings) -> list[list[int]]:
    """The exact sums of (x_i - centre_i) * (x_j - centre_j) over all rows, if they are smaller than half the product of ``moduli``."""
    size, shift = len(centre), np.array(centre, np.int64)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), size, size), np.int64)
        for batch in batches:
            for _, x in integers(batch.column(0), settings):
                if x.shape[1] != size:
                    continue
                for low in range(0, len(x), GEMM_ROWS):
                    y = x[low : low + GEMM_ROWS] - shift
                    for k, p in enumerate(moduli):
                        r = y % p
                        r = (r - p * (r > p // 2)).astype(float)
                        sums[k] = (sums[k] + np.rint(r.T @ r).astype(np.int64)) % p
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k][upper].tolist()], pa.list_(pa.int64()))], names=["prime", "residue"])

    parts = vectors.select("vector").mapInArrow(run, "prime int, residue array<long>")
    rows = _summed(parts, ["prime"], ["residue"], ["sum"]).collect()  # dimensions * (dimensions + 1) / 2 rows for each prime
    residues = [[0] * len(upper[0]) for _ in moduli]
    for r in rows:
        residues[r.prime][r["at"]] = r.residue % moduli[r.prime]
    product = math.prod(moduli)
    basis = [product // p * pow(product // p, -1, p) for p in moduli]
    out = [[0] * size for _ in range(size)]
    for i, j, *found in zip(*(u.tolist() for u in upper), *residues):
        value = sum(r * b for r, b in zip(found, basis)) % product
        out[i][j] = out[j][i] = value - product if value > product // 2 else value
    return out


def fit(vectors: DataFrame, settings: Settings = Settings()) -> Whitening | None:
    """The whitening of ``vectors`` (vector: array of doubles), over all rows; None if there are none.

    Two passes: counts and sums, then the scatter about the whole part of the mean, with as many primes
    as its largest possible size needs. What comes to the driver has the size of the covariance.
    """
    n, sums, least, most = moments(vectors, settings)
    if not n:
        return None
    centre = [s // n for s in sums]
    largest = max(max(abs(low - c), abs(high - c)) + 1 for low, high, c in zip(least, most, centre))
    bits = 2 * largest.bit_length() + n.bit_length() + 2
    exact = scatter(vectors, centre, primes(-(-bits // (PRIME_BITS - 1))), settings)
    rest = [s - n * c for s, c in zip(sums, centre)]
    # divisions of whole numbers are rounded once
    covariance = np.array([[(n * e - a * b) / (n * n) for e, b in zip(row, rest)] for row, a in zip(exact, rest)])
    values, axes = np.linalg.eigh(covariance)
    trace = sum(n * exact[k][k] - rest[k] ** 2 for k in range(len(sums))) / (n * n)
    kept = min(settings.components, len(sums))
    model = Whitening(n, sums, n * (largest + 1), np.ascontiguousarray(axes[:, ::-1][:, :kept]), values[::-1][:kept], trace, settings)
    model.identity_error = identity_error(vectors, model)
    return model


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(rows, components) whitened values of integer rows; 0 for components beyond the rank."""
    centre = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * c) / model.n for s, c in zip(model.sums, centre)])
    scale = np.zeros(len(model.values))
    scale[: model.rank] = 1 / np.sqrt(model.values[: model.rank])
    return ((x - np.array(centre, np.int64)).astype(float) - rest) @ model.vectors * scale


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The exact sum of (n * x - sums)**2 over the dimensions of each row; None where it doesn't fit a long."""
    if model.size * model.largest**2 < 1 << 63:
        d = model.n * x - np.array(model.sums, np.int64) if model.n * int(np.abs(x).max(initial=0)) < 1 << 62 else _wide(x, model).astype(np.int64)
        return (d * d).sum(1).tolist()
    return [int(v) if v < 1 << 63 else None for v in (_wide(x, model) ** 2).sum(1).tolist()]


def _wide(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums in whole numbers of any size."""
    return x.astype(object) * model.n - np.array(model.sums, object)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the covariance of the whitened values minus the identity, over the components up to the rank."""
    rank, size = model.rank, model.size
    if not rank:
        return 0.0
    held, upper = vectors.sparkSession.sparkContext.broadcast(model), np.triu_indices(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(rank), np.zeros((rank, rank))
        for batch in batches:
            for _, x in integers(batch.column(0), held.value.settings):
                if x.shape[1] == size:
                    w = projected(x, held.value)[:, :rank]  # centred already
                    total, products = total + w.sum(0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), *products[upper].tolist()]], pa.list_(pa.float64()))], names=["sums"])

    rows = _summed(vectors.select("vector").mapInArrow(run, "sums array<double>"), [], ["sums"], ["sum"]).orderBy("at").collect()
    found = np.array([r.sums for r in rows]) / model.n
    covariance = np.zeros((rank, rank))
    covariance[upper] = found[rank:]
    return float(np.abs(np.triu(covariance - np.outer(found[:rank], found[:rank]) - np.eye(rank))).max())


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, from 1 by falling eigenvalue.

    Rows whose vector is null or empty, has entries that are null, not finite or 2**56 and more in size,
    or is of another length than most, are left out; null and repeated keys are rows as any. Components
    whose eigenvalue is zero but for rounding have whitened 0 and don't count in identity_error. A
    deviation beyond a long is null. Other columns are not read.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at, x in integers(batch.column(1), model.settings) if model else ():
                if x.shape[1] != model.size:
                    continue
                m, r = len(model.values), len(x)
                ids = batch.column(0).take(pa.array(np.repeat(at, m)))
                explained = np.maximum(model.values, 0) / model.trace if model.trace > 0 else np.zeros(m)
                columns = [np.tile(np.arange(1, m + 1, dtype=np.int32), r), np.full(m * r, model.n), None, projected(x, model).ravel(), np.tile(explained, r), np.full(m * r, model.identity_error)]
                spread = pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(r), m)))
                yield pa.RecordBatch.from_arrays([ids, *(spread if c is None else pa.array(c) for c in columns)], names=names)

    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def op12_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every embedding, fitted on all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows, fit(rows.select(F.col("embedding").cast("array<double>").alias("vector"))))
