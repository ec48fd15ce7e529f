"""Exact nearest neighbours with pruning: a join of two tables of vectors, apart for every key (a cloud, a sample).

The bank's vectors are parted by their nearest pivot, some of the bank's own vectors. A query first looks into
the cells of its nearest pivots, which bounds the distance of its k-th neighbour. By the triangle inequality the
bound rules out cells, and in those that are left all vectors whose distance to the pivot differs too
much from the query's. Cells travel in groups of bounded size, and a query goes once to every group that it needs,
so data without structure cost as much as comparing blocks with blocks, and data with structure far less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlight.sources.shared import apart, written


#: Distances that ``best_of`` has in memory at once, about.
CELLS = 1 << 20


def best_of(ids: np.ndarray, x: np.ndarray, bank_ids: np.ndarray, bank: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(vec_id, bank_id, dist) of the ``k`` nearest of a block, ties by bank_id.

    Squared distances come from the norm expansion as one matrix product for each slice of queries, so many that it has about
    ``CELLS`` distances; all that rounding could put among the k best are then measured directly, however many they are.
    """
    norms = (bank**2).sum(1)
    step = min(256, max(1, CELLS // max(1, len(bank))))
    for at in range(0, len(ids), step):
        q = x[at : at + step]
        d = (-2 * q) @ bank.T
        d += norms
        take = min(k, len(bank))
        slack = 1e-9 * (norms.max() + (q**2).sum(1) + 1e-300)
        limit = (d.min(1) if take == 1 else np.partition(d, take - 1, axis=1)[:, take - 1]) + slack
        row, col = np.nonzero(d <= limit[:, None])
        exact = np.concatenate([np.sqrt(((q[row[j : j + 100_000]] - bank[col[j : j + 100_000]]) ** 2).sum(1)) for j in range(0, len(row), 100_000)])
        order = np.lexsort((bank_ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        kept = np.arange(len(row)) - first[row] < k
        yield pd.DataFrame({"vec_id": ids[at + row[kept]], "bank_id": bank_ids[col[kept]], "dist": exact[kept]})


@dataclass(frozen=True)
class Settings:
    """Pivots of a key (``ratio`` times the root of its vectors, ``most`` about), vectors of a group of cells, and queries of a task.

    Keys whose bank has at most ``few`` vectors are measured without pivots, several of them in a task.
    """

    ratio: float = 1.0
    most: int = 1024
    group: int = 20_000
    least_groups: int = 8
    queries: int = 20_000
    few: int = 400


def _dealt(rows: DataFrame, keys: list[str], ident: str, size: int) -> DataFrame:
    """``rows`` with _part: each key's rows in parts of about ``size``, and _parts."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_parts"))
    return rows.join(n, keys).withColumn("_part", F.pmod(F.xxhash64(F.col(ident)), F.col("_parts")).cast("int"))


def _for_parts(one: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The one row of each key, once for each part of ``rows``, named _of."""
    return one.join(rows.select(*keys, F.col("_part").alias("_of")).distinct(), keys)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``, a slice of ``x`` and a component at a time, so that what is worked on stays in the cache."""
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T) if len(y) else ()
    for at in range(0, len(x), 128):
        own = out[at : at + 128]
        apart = np.empty_like(own)
        for a, b in zip(x[at : at + 128].T, columns):
            np.subtract(a[:, None], b, out=apart)
            apart *= apart
            own += apart
    return np.sqrt(out, out=out)


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), float).reshape(len(packed), -1)


class Directory:
    """The cells of one key: pivots, and for each part of a cell its group, its number of vectors and the range of their distances to the pivot."""

    def __init__(self, row: pd.Series):
        self.pivots = np.array([list(v) for v in row["pivots"]], float)
        entries = sorted((e["cell"], e["group"], e["n"], e["low"], e["high"]) for e in row["entries"])
        self.cell, self.group, self.n = (np.array([e[k] for e in entries], np.int64) for k in range(3))
        self.low, self.high = (np.array([e[k] for e in entries], float) for k in (3, 4))
        self.between = _far(self.pivots, self.pivots)
        self.size = np.bincount(self.cell, self.n, len(self.pivots))

    def home(self, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """(queries, entries): the parts of cells that bound a query's k-th distance: the nearest cells that together have k vectors; of a cell in many parts a single one, if that has enough."""
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        wanted = np.zeros(far.shape, bool)
        np.put_along_axis(wanted, order, held - self.size[order] < k, axis=1)
        parts = np.bincount(self.cell, minlength=len(self.pivots))
        place = np.arange(len(self.cell)) - np.searchsorted(self.cell, self.cell)
        one = (self.n >= k)[None] & (place[None] == ids[:, None] % parts[self.cell][None])
        enough = np.zeros(far.shape, bool)  # whether the query's own part of a cell has k
        rows, entries = np.nonzero(one)
        enough[rows, self.cell[entries]] = True
        return wanted[:, self.cell] & (one | ~enough[:, self.cell])

    def possible(self, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """(queries, entries): the parts of cells that can hold a vector within ``limit``."""
        own = far.argmin(1)
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (far**2 - far[np.arange(len(far)), own][:, None] ** 2) / (2 * apart), 0.0)
        least = np.maximum(np.maximum(far[:, self.cell] - self.high, self.low - far[:, self.cell]), plane[:, self.cell])
        slack = 1e-9 * (1 + far.max(1, initial=0.0)[:, None] + self.high.max(initial=0.0))
        return least <= limit[:, None] + slack


def _sent(ids: np.ndarray, packed: np.ndarray, far: np.ndarray, limit: np.ndarray, chosen: np.ndarray, book: Directory) -> Iterator[tuple]:
    """(vec_id, packed, group, cells, distances to their pivots, limit) of queries: a row for each group that has a chosen entry."""
    q, e = np.nonzero(chosen)
    order = np.lexsort((book.cell[e], book.group[e], q))
    q, e = q[order], e[order]
    cuts = np.flatnonzero((np.diff(q) != 0) | (np.diff(book.group[e]) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(q)]):
        if b > a:
            cells = book.cell[e[a:b]]
            yield int(ids[q[a]]), packed[q[a]], int(book.group[e[a]]), cells.tolist(), far[q[a], cells].tolist(), float(limit[q[a]])


def _compare(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """(vec_id, bank_id, dist, compared): the k nearest of each query in one group of cells; ``compared`` counts in one row of each query."""
    out: list[pd.DataFrame] = []
    counts = np.zeros(len(left), np.int64)
    if len(left) and len(right):
        right = right.sort_values(["cell", "far", "bank_id"])
        bank, ids, cell, far = _matrix(right["packed"]), right["bank_id"].to_numpy(), right["cell"].to_numpy(), right["far"].to_numpy()
        x, limit = _matrix(left["packed"]), left["limit"].to_numpy()
        row = np.repeat(np.arange(len(left)), left["cells"].map(len))
        wanted, near = np.concatenate([*map(np.asarray, left["cells"])]), np.concatenate([*map(np.asarray, left["near"])])
        slack = 1e-9 * (1 + far.max() + near.max())
        # a query's cells by distance: the first round has every query's nearest cell, and what is found there narrows the next
        order = np.lexsort((near, row))
        row, wanted, near = row[order], wanted[order], near[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        begins, ends = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, side="right")
        low_of, high_of = far[np.minimum(begins, len(far) - 1)], far[ends - 1]
        best = np.full((len(left), k), np.inf)
        for r in range(int(turn.max()) + 1):
            at = np.flatnonzero((turn == r) & (ends > begins))
            reach = np.minimum(limit, best[:, -1])[row[at]] + slack
            at = at[(near[at] - reach <= high_of[at]) & (near[at] + reach >= low_of[at])]
            at = at[np.lexsort((near[at], wanted[at]))]
            for group in np.split(at, np.flatnonzero(np.diff(wanted[at])) + 1) if len(at) else ():
                a, b = begins[group[0]], ends[group[0]]
                for c in range(0, len(group), 32):
                    own = group[c : c + 32]
                    some, reach = row[own], np.minimum(limit, best[:, -1])[row[own]] + slack
                    low = a + np.searchsorted(far[a:b], (near[own] - reach).min())
                    high = a + np.searchsorted(far[a:b], (near[own] + reach).max(), side="right")
                    if high <= low:
                        continue
                    counts[some] += high - low
                    for part in best_of(some, x[some], ids[low:high], bank[low:high], k):
                        out.append(part)
                        q = part["vec_id"].to_numpy()
                        first = np.concatenate([[0], np.flatnonzero(np.diff(q) != 0) + 1])
                        size = np.diff(np.append(first, len(q)))
                        new = np.full((len(first), k), np.inf)
                        new[np.repeat(np.arange(len(first)), size), np.arange(len(q)) - np.repeat(first, size)] = part["dist"]
                        best[q[first]] = np.sort(np.concatenate([best[q[first]], new], 1), 1)[:, :k]
    found = pd.concat(out) if out else pd.DataFrame({"vec_id": np.zeros(0, int), "bank_id": np.zeros(0, int), "dist": np.zeros(0)})
    found = found.sort_values(["vec_id", "dist", "bank_id"])
    found = found[found.groupby("vec_id").cumcount() < k] if len(found) else found
    at = found["vec_id"].to_numpy(np.int64)
    found = pd.DataFrame({"vec_id": left["vec_id"].to_numpy()[at], "bank_id": found["bank_id"].astype("Int64"), "dist": found["dist"], "compared": 0})
    count = pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "bank_id": pd.array([None] * len(left), "Int64"), "dist": np.nan, "compared": counts})
    return pd.concat([found, count])


def _measured(queries: DataFrame, bank: DataFrame, keys: list[str], key_schema: str, k: int, settings: Settings) -> DataFrame:
    """(vec_id, bank_id, dist, compared, keys) of keys with small banks, every pair of a key measured; keys share tasks of bounded size."""
    bank = bank.drop("_part", "_parts").join(queries.select(*keys, "_part").distinct(), keys)
    tasks = max(settings.least_groups, -(-(queries.count() + bank.count()) // settings.queries))
    task = F.pmod(F.xxhash64(*keys, "_part"), F.lit(tasks)).alias("_task")
    at = [*keys, "_part"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series([], dtype=object) for c in ["vec_id", "bank_id", "dist", "compared", *keys]})]
        theirs = dict(tuple(right.groupby(at, sort=False)))
        for key, own in left.groupby(at, sort=False):
            if key not in theirs:
                continue
            f = theirs[key]
            ids, y = f["bank_id"].to_numpy(np.int64), np.array(f["embedding"].tolist(), float)
            names, x = own["vec_id"].to_numpy(np.int64), np.array(own["embedding"].tolist(), float)
            found = pd.concat(best_of(names, x, ids, y, k)).assign(compared=0)
            found["bank_id"] = found["bank_id"].astype(object)
            count = pd.DataFrame({"vec_id": names, "bank_id": None, "dist": None, "compared": len(ids)})
            out += [part.assign(**dict(zip(keys, key))) for part in (found, count)]
        return pd.concat(out)

    left, right = queries.select(*at, "vec_id", "embedding", task), bank.select(*at, F.col("vec_id").alias("bank_id"), "embedding", task)
    return left.groupBy("_task").cogroup(apart(right).groupBy("_task")).applyInPandas(run, f"vec_id long, bank_id long, dist double, compared long, {key_schema}")


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1, keys: list[str] | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(found, compared) for ``queries`` and ``bank`` (keys, vec_id, embedding): found has (keys, vec_id, rank, bank_id, dist), the k nearest by Euclidean distance within the same key, ties by bank_id.

    ``compared`` (keys, vec_id, compared) says how many distances each query took, to pivots and vectors. Null
    vectors and null keys are left out; vec_ids are unique within a key, and a key's vectors have one length. A key without a bank
    gives no rows, one with fewer than k vectors all of them. Pivots and cells of a key are one row of bounded size
    (about ``most`` pivots, and an entry for each group of cells).
    """
    whole = not keys
    keys = keys or ["_key"]
    plain = lambda df: (df.withColumn("_key", F.lit(0)) if whole else df).where(F.col("embedding").isNotNull()).select(*keys, "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = dict(plain(bank).dtypes)
    key_schema = ", ".join(f"{c} {kinds[c]}" for c in keys)
    named = lambda f, extra: pd.DataFrame({**{c: f[c].iloc[0] for c in keys}, **extra})
    empty = lambda names: pd.DataFrame({c: pd.Series([], dtype=object) for c in names})

    rows = written(_dealt(plain(bank), keys, "vec_id", settings.queries), "bank")
    mixed: Column = F.xxhash64("vec_id", F.lit(7))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by("vec_id", mixed).alias("_first"))
    sizes = written(sizes, "sizes")
    asked = written(_dealt(plain(queries), keys, "vec_id", settings.queries), "queries")
    whole_keys, many = sizes.where(F.col("_n") <= settings.few), sizes.where(F.col("_n") > settings.few)
    own = [] if whole else keys
    best = lambda df: df.where("bank_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "vec_id").orderBy("dist", "bank_id"))).where(F.col("rank") <= k).select(*own, "vec_id", "rank", "bank_id", "dist")
    direct = written(_measured(asked.join(whole_keys.select(*keys), keys), rows.join(whole_keys.select(*keys), keys), keys, key_schema, k, settings), "direct")
    direct_cost = direct.where("bank_id is null").select(*own, "vec_id", "compared")
    if many.isEmpty():
        return best(direct), direct_cost
    rows, asked = rows.join(many.select(*keys), keys), asked.join(many.select(*keys), keys)
    picked = rows.join(many, keys).where((F.pmod(mixed, F.col("_n")) < F.least(F.lit(settings.most), F.ceil(settings.ratio * F.sqrt("_n")))) | (F.col("vec_id") == F.col("_first")))
    pivots = written(picked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda e: e.embedding).alias("pivots")), "pivots")

    def place(f: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(one):
            return empty([*keys, "bank_id", "packed", "cell", "far"])
        x, p = np.array(f["embedding"].tolist(), float), np.array([list(v) for v in one["pivots"].iloc[0]], float)
        far = _far(x, p)
        cell = far.argmin(1)
        return named(f, {"bank_id": f["vec_id"].to_numpy(), "packed": [v.tobytes() for v in x], "cell": cell, "far": far[np.arange(len(x)), cell]})

    parts = rows.groupBy(*keys, "_part").cogroup(apart(_for_parts(pivots, rows, keys)).groupBy(*keys, "_of"))
    placed = written(parts.applyInPandas(place, f"{key_schema}, bank_id long, packed binary, cell int, far double"), "placed")

    # cells of a key, in the order of their pivots, fill groups of bounded size; larger cells are dealt into groups of their own
    cells = placed.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    target = F.least(F.lit(settings.group), F.greatest(F.lit(64), F.ceil(F.sum("n").over(Window.partitionBy(*keys)) / F.lit(settings.least_groups))))
    cells = cells.withColumn("splits", F.ceil(F.col("n") / target).cast("int")).withColumn("room", F.when(F.col("splits") > 1, F.col("splits") * target).otherwise(F.col("n")))
    before = F.sum("room").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    # a cell in several groups begins a new one, and so does the next
    base = F.ceil(F.coalesce(before, F.lit(0)) / target).cast("int")
    cells = cells.withColumn("base", F.when(F.col("splits") > 1, base).otherwise(F.floor(F.coalesce(before, F.lit(0)) / target).cast("int")))
    bank_rows = written(placed.join(cells.select(*keys, "cell", "splits", "base"), [*keys, "cell"]).withColumn("group", F.col("base") + F.pmod(F.xxhash64("bank_id", F.lit(3)), F.col("splits")).cast("int")).drop("splits", "base"), "cells")
    entries = bank_rows.groupBy(*keys, "cell", "group").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    book = written(entries.groupBy(*keys).agg(F.collect_list(F.struct("cell", "group", "n", "low", "high")).alias("entries")).join(pivots, keys), "book")

    sent_schema = f"{key_schema}, vec_id long, packed binary, group int, cells array<int>, near array<double>, limit double"

    def send(second: bool):
        def run(f: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
            names = ["vec_id", "packed", "group", "cells", "near", "limit"]
            if not len(f) or not len(one):
                return empty([*keys, *names])
            directory, out = Directory(one.iloc[0]), []
            x, ids = np.array(f["embedding"].tolist(), float), f["vec_id"].to_numpy(np.int64)
            limit = f["limit"].fillna(np.inf).to_numpy() if second else np.full(len(x), np.inf)
            packed = [v.tobytes() for v in x]
            for at in range(0, len(x), 1000):
                far, own = _far(x[at : at + 1000], directory.pivots), slice(at, at + 1000)
                chosen = directory.home(far, ids[own], k)
                if second:
                    chosen = directory.possible(far, limit[own]) & ~chosen
                out += _sent(ids[own], packed[own], far, limit[own], chosen, directory)
            return named(f, dict(zip(names, map(list, zip(*out))))) if out else empty([*keys, *names])

        return run

    def compared(sent: DataFrame) -> DataFrame:
        """The k nearest in every group that a query was sent to; a group's queries are dealt to several tasks, which all get its vectors."""
        n = sent.groupBy(*keys, "group").agg(F.ceil(F.count("*") / F.lit(settings.queries)).cast("int").alias("_tasks"))
        left = sent.join(n, [*keys, "group"]).withColumn("_task", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("_tasks")).cast("int"))
        right = bank_rows.join(n, [*keys, "group"]).withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
        at = [*keys, "group"]
        run = lambda a, b: _compare(a, b, k).assign(**{c: a[c].iloc[0] for c in keys}) if len(a) else empty(["vec_id", "bank_id", "dist", "compared", *keys])
        return left.groupBy(*at, "_task").cogroup(apart(right).groupBy(*at, "_of")).applyInPandas(run, f"vec_id long, bank_id long, dist double, compared long, {key_schema}")

    pairs = lambda df: df.groupBy(*keys, "_part").cogroup(apart(_for_parts(book, df, keys)).groupBy(*keys, "_of"))
    first = written(compared(written(pairs(asked).applyInPandas(send(False), sent_schema), "sent")), "first")
    limits = first.where("bank_id is not null").groupBy(*keys, "vec_id").agg(F.sort_array(F.collect_list("dist")).alias("d")).select(*keys, "vec_id", F.get("d", F.lit(k - 1)).alias("limit"))
    again = pairs(asked.join(limits, [*keys, "vec_id"], "left")).applyInPandas(send(True), sent_schema)
    both = written(first.unionByName(compared(written(again, "sent"))), "compared")
    looked = book.select(*keys, (2 * F.size("pivots")).alias("_pivots"))
    cost = both.groupBy(*keys, "vec_id").agg(F.sum("compared").alias("compared")).join(looked, keys).select(*own, "vec_id", (F.col("compared") + F.col("_pivots")).alias("compared"))
    return best(both.unionByName(direct)), cost.unionByName(direct_cost)
