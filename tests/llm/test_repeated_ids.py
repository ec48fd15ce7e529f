"""Rows that repeat a doc_id or vec_id with other contents, and rows without an id, against brute force over rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from gridlight.llm import decontaminate, embedding_links, near_duplicates


def reached(n, pairs):
    """For each of n rows the rows that it reaches over pairs."""
    group = [{k} for k in range(n)]
    for a, b in pairs:
        both = group[a] | group[b]
        for k in both:
            group[k] = both
    return group


def text(seed, changed=0):
    words = [f"w{random.Random(f'{seed}-{k}').randrange(10**6)}" for k in range(120)]
    return " ".join(words[:-1] + ["other"] if changed else words)


@pytest.mark.parametrize("settings", [near_duplicates.Settings(), near_duplicates.Settings(pairs_up_to=2, block=3)])
def test_near_duplicates_with_repeated_ids(spark, settings):
    rows = [(5, text("a")), (5, text("b")), (6, text("a", 1)), (7, text("b", 1)), (5, None), (5, ""), (8, text("c")), (8, text("c")), (9, text("c", 1)), (3, text("d")), (10, text("d", 1)), (3, text("e")), (None, text("a"))]
    rows += [(20, text(f"same id {k}", 0)) for k in range(12)] + [(30 + k, text(f"same id {k}", 1)) for k in range(12)]
    rows += [(60 + k, " ".join([text("crowd"), f"end{k}"])) for k in range(8)]
    own = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, t in rows if i is not None for w in [(t or "").split()]]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if own[a][1] and 100 * len(own[a][1] & own[b][1]) >= 85 * len(own[a][1] | own[b][1])]
    groups = reached(len(own), pairs)
    want = sorted((i, len(s), min(own[k][0] for k in g)) for (i, s), g in zip(own, groups))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), settings).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [1024, 3])
def test_embedding_links_with_repeated_ids(spark, block):
    pick = np.random.default_rng(6)
    base = pick.normal(size=(9, 16))
    near = lambda k: (base[k] + 0.05 * pick.normal(size=16)).tolist()
    rows = [(1, near(0)), (1, near(1)), (2, near(0)), (3, near(1)), (3, near(1)), (4, near(2)), (1, base[3].tolist()), (5, base[3].tolist()), (5, (2 * base[3]).tolist()), (1, None), (1, [0.0] * 16), (2, [float("nan")] * 16), (None, near(0))]
    rows += [(7, near(4 + k % 4)) for k in range(40)]
    own = [(i, v) for i, v in rows if i is not None]
    unit = [None if v is None or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.linalg.norm(v) for _, v in own]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.95]
    groups = reached(len(own), pairs)
    want = sorted((i, sum(k in p for p in pairs), min(own[j][0] for j in groups[k])) for k, (i, _) in enumerate(own))
    got = embedding_links.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), embedding_links.Settings(block=block)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_decontamination_of_rows_without_ids(spark, tmp_path):
    rows = [(None, f"x {ITEM} y"), (None, "clean words"), (7, f"{ITEM}"), (7, "also clean"), (None, None), (8, None), (1 << 60, ITEM)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, _row0 int, row string")
    items = spark.createDataFrame([("q", ITEM), (None, "clean words")], "item_id string, text string")
    got = [(r.doc_id, r.n_words, decontaminate.span_words(bytes(r.spans)), list(r["items"])) for r in decontaminate.contamination(docs, items).collect()]
    want = [(i, len((t or "").split()), 10 if t and ITEM in t else 0, ["q"] if t and ITEM in t else []) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    items.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = decontaminate.stage(spark, docs, f"file://{tmp_path}")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if not r[1] or ITEM not in r[1]], key=str)


@pytest.mark.parametrize("slack", [0, 1, 3])
def test_phrases_against_brute_force(spark, slack, monkeypatch):
    """Every place whose window's words all stand at most ``slack`` words off; candidates in many small chunks."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    pick = random.Random(slack)
    texts = [[pick.choice("abc") for _ in range(pick.randint(0, 30))] for _ in range(25)]
    windows = sorted({tuple(pick.choices("abcd", k=pick.choice((3, 4)))) for _ in range(40)})
    index = decontaminate.build_index(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    block = decontaminate.BlockIndex(index.toPandas())
    number, at = block.phrases([tuple(w.encode() for w in x) for x in windows], slack)
    flat = [w for k in block.ids for w in texts[k]]
    doc_of = np.repeat(np.arange(len(texts)), block.lengths)
    has = {w: [k for k, x in enumerate(flat) if x == w] for w in "abcd"}
    want = []
    for n, w in enumerate(windows):
        for p in range(len(flat) - len(w) + 1):
            inside = doc_of[p] == doc_of[p + len(w) - 1]
            exact_first = flat[p + (first := min(range(len(w)), key=lambda k: (len(has[w[k]]), k)))] == w[first]
            if inside and exact_first and all(any(abs(k - (p + j)) <= slack for k in has[c]) for j, c in enumerate(w)):
                want.append((n, p))
    assert sorted(zip(number.tolist(), at.tolist())) == want


def test_a_block_of_two_words_needs_little_memory():
    import tracemalloc

    import pandas as pd

    n = 400_000
    pick = np.random.default_rng(1)
    code = pick.integers(0, 2, n)
    places = [np.flatnonzero(code == k).astype("<i4") for k in (0, 1)]
    rows = [(b"", np.array([1, 0, 1], "<i8").tobytes(), np.array([n], "<i4").tobytes())] + [(w, np.zeros(len(p), "<i4").tobytes(), p.tobytes()) for w, p in zip((b"0", b"1"), places)]
    block = decontaminate.BlockIndex(pd.DataFrame(rows, columns=["term", "docs", "positions"]))
    windows = [tuple(b"01"[b : b + 1] for b in bits) for bits in itertools.product((0, 1), repeat=8)]
    tracemalloc.start()
    number, at = block.phrases(windows)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert len(at) == n - 7 and hashlib.sha1(np.sort(at).tobytes()).digest() == hashlib.sha1(np.arange(n - 7).tobytes()).digest()
