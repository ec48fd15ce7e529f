"""Sums over arrays in Arrow batches: Gram matrices, moments by key, and the models that follow from them.

Every partition sends its sums once for each key, they are added up place by place, and a model has the size of
its sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.sources.shared import apart


def added(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, ``column``) with the arrays of each key, all of one length, added up place by place; combined before the shuffle."""
    each = parts.select(*keys, F.posexplode(column).alias("_at", "_v")).groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda e: e._v).alias(column))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) doubles of a list array whose lists have one length; rows that are null, or hold nulls, are not numbers."""
    lists = column.to_pylist()
    width = max((len(x) for x in lists if x is not None), default=0)
    return np.array([[np.nan] * width if x is None else [np.nan if v is None else v for v in x] for x in lists], float).reshape(len(lists), width)


@dataclass
class Linear:
    """Weights (inputs + 1, outputs); the last row is the intercept."""

    weights: np.ndarray
    rows: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def least_squares(rows: DataFrame, x: str, y: str, ridge: float = 0.0) -> Linear:
    """The linear model from array ``x`` to array ``y`` of least squares (of smallest norm where there are several), from one aggregate of products.

    Rows with a null or not finite number are left out; without rows the weights are zero. ``ridge`` is added to the
    squares of the weights but the intercept's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            a, b = matrix(batch.column(0)), matrix(batch.column(1))
            both = np.concatenate([a, np.ones((len(a), 1)), b], 1)
            both = both[np.isfinite(both).all(1)]
            if len(both):
                own = np.concatenate([[a.shape[1], b.shape[1]], (both.T @ both).ravel()])
                total = own if total is None else np.concatenate([own[:2], total[2:] + own[2:]])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(total[0])]), pa.array([int(total[1])]), pa.array([total[2:].tolist()], pa.list_(pa.float64()))], names=["p", "q", "sums"])

    found = added(rows.select(x, y).mapInArrow(run, "p long, q long, sums array<double>"), ["p", "q"], "sums").collect()  # one row of the model's size
    if not found:
        return Linear(np.zeros((1, 1)), 0)
    if len(found) > 1:
        raise ValueError("inputs or outputs of different lengths")
    p, q = found[0].p, found[0].q
    g = np.array(found[0].sums).reshape(p + 1 + q, -1)
    gram = g[: p + 1, : p + 1] + ridge * np.diag([1.0] * p + [0.0])
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))  # columns of one size, so that small ones count
    solved = np.linalg.lstsq(gram / scale[:, None] / scale[None], g[: p + 1, p + 1 :] / scale[:, None], rcond=1e-13)[0] / scale[:, None]
    return Linear(solved, round(g[p, p]))


def predicted(rows: DataFrame, model: Linear, x: str, out: str) -> DataFrame:
    """``rows`` with an array column ``out``, what the model gives for ``x``; null where ``x`` is null or has a null."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # of the model's size
    plain = rows.drop(out)
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = matrix(batch.column(names.index(x)))
            y = held.value(a) if a.shape[1] + 1 == len(held.value.weights) else np.full((len(a), 1), np.nan)
            column = pa.array([v.tolist() if np.isfinite(v).all() else None for v in y], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, out])

    return plain.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{out}` array<double>")


def sketch(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, d, sums): mergeable moments of vectors about a fixed vector of the table (that of the first row): n, sums, products, fourth moments.

    ``sums`` is laid out as n, d sums, d * d products, sum of |y|^4, and d sums of |y|^2 y, then the fixed vector
    itself n times. Rows with a null, or numbers that aren't finite, are left out.
    """
    first = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))).select(F.col(vector).cast("array<double>").alias("v")).first()
    shift = np.array(first.v if first else [], float)
    shift = np.where(np.isfinite(shift), shift, 0.0)
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, g in f.groupby(keys, dropna=False):
                x = [v for v in g["_x"] if v is not None and len(v) == len(shift)]
                y = np.array([list(v) for v in x], float).reshape(len(x), len(shift)) - shift
                y = y[np.isfinite(y).all(1)]
                square = (y**2).sum(1)
                own = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel(), [(square**2).sum()], square @ y, len(y) * shift])
                found[key] = found.get(key, 0) + own
        yield pd.DataFrame([(*k, len(shift), v.tolist()) for k, v in found.items()], columns=[*keys, "d", "sums"])

    parts = rows.select(*keys, F.col(vector).cast("array<double>").alias("_x")).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", d int, sums array<double>")
    return added(parts, [*keys, "d"], "sums")


def shrunk(d: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, share) by the shrinkage of Ledoit and Wolf towards a multiple of the identity, from a key's sums of ``sketch``."""
    n, first, products, fourth, third, shift = sums[0], sums[1 : 1 + d], sums[1 + d : 1 + d + d * d].reshape(d, d), sums[1 + d + d * d], sums[2 + d + d * d : 2 + 2 * d + d * d], sums[2 + 2 * d + d * d :] / sums[0]
    m = first / n
    cov = products / n - np.outer(m, m)
    mm = m @ m
    # the sum of |y - m|^4, multiplied out
    about = fourth + 4 * m @ products @ m + n * mm**2 - 4 * m @ third + 2 * mm * np.trace(products) - 4 * mm * (m @ first)
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
    beta = min(delta, max(0.0, (about / n - (cov**2).sum()) / (d * n)))
    share = beta / delta if delta else 0.0
    return shift + m, (1 - share) * cov + share * mu * np.eye(d), share


def mahalanobis(train: DataFrame, test: DataFrame, keys: list[str], ident: str = "vec_id", vector: str = "embedding", part: int = 20_000) -> DataFrame:
    """(keys, ident, dist): the distance of each ``test`` vector to its key's ``train`` vectors, under their shrunk covariance, in full dimension.

    A key's mean and inverse are made where its test vectors are, from its one row of sums; a key's vectors are dealt
    in parts. Keys without train vectors have no rows; vectors that are null, of another length or not finite have
    a null distance; a covariance of zero gives a null, too.
    """
    kinds = dict(test.dtypes)
    plain = test.select(*keys, ident, F.col(vector).cast("array<double>").alias("_x"))
    n = plain.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("_parts"))
    left = plain.join(n, keys).withColumn("_part", F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int"))
    right = sketch(train, keys, vector).join(n, keys).withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def run(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(s) or not s["sums"].iloc[0][0]:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, ident, "dist"]})
        d = int(s["d"].iloc[0])
        mean, cov, _ = shrunk(d, np.asarray(s["sums"].iloc[0], float))
        x = np.array([list(v) if v is not None and len(v) == d else [np.nan] * d for v in f["_x"]], float) - mean
        try:
            dist = np.sqrt(np.maximum(np.einsum("ni,ni->n", x, np.linalg.solve(cov, x.T).T), 0))
        except np.linalg.LinAlgError:
            dist = np.full(len(x), np.nan)
        return f[[*keys, ident]].assign(dist=[v if np.isfinite(v) else None for v in dist.tolist()])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, ident]) + ", dist double"
    return left.groupBy(*keys, "_part").cogroup(apart(right).groupBy(*keys, "_of")).applyInPandas(run, schema)
