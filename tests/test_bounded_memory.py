"""Tasks whose memory doesn't grow with their blocks or batches."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridlight.operators import bank, neighbours, preprocess


def peak(run):
    tracemalloc.start()
    run()
    found = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found


def test_nearest_of_a_large_block_in_slices():
    pick = np.random.default_rng(4)
    x, y = pick.normal(size=(300, 8)), pick.normal(size=(bank.BANK_BLOCK, 8))
    ids, bank_ids = np.arange(300), np.arange(len(y))
    assert peak(lambda: [None for _ in neighbours.best_of(ids, x, bank_ids, y, 3)]) < 40
    for k in (1, 3):
        got = {}
        for f in neighbours.best_of(ids, x, bank_ids, y, k):
            for r in f.itertuples():
                got.setdefault(r.vec_id, []).append(r.bank_id)
        assert got == {i: np.argsort(((x[i] - y) ** 2).sum(1), kind="stable")[:k].tolist() for i in ids}


def test_blocks_are_of_bounded_size():
    assert max(bank.BANK_BLOCK, bank.QUERY_BLOCK) <= 20_000


def test_scans_are_made_a_few_at_a_time():
    n, recipe = 300, preprocess.Recipe(size=64, scale=1.0)
    lists = lambda values, kind: pa.array([values] * n, pa.list_(kind))
    columns = {c: lists([1.0, 2.0, 3.0, 4.0], pa.float64()) for c in "xyz"} | {c: lists([True] * 4, pa.bool_()) for c in ("valid", "gt")}
    columns |= {"_gone": pa.array([None] * n, pa.list_(pa.int64())), "h": pa.array([2] * n, pa.int32()), "w": pa.array([2] * n, pa.int32()), "name": pa.array(map(str, range(n)))}
    batch, sizes, names = pa.RecordBatch.from_pydict(columns), [], []

    def run():
        for part in preprocess.made(batch, ["name"], recipe):
            sizes.append(len(part["x"].flatten()))
            names.extend(part["name"].to_pylist())

    assert peak(run) < 40  # all 300 at once are 1.2 million pixels of three doubles and two marks, as objects some 130 MB
    assert max(sizes) <= preprocess.PIXELS and sum(sizes) == n * 64 * 64 and names == [*map(str, range(n))]
