"""Quality rules (operator 11): counts against a plain version, trees against a walk node by node, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated)


def failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def test_documents_table(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = quality.op11_boosted_quality(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert (*(r[c] for c in quality.BASE), r.base_failed) == (*want, failed(want))
        assert r.kept == (not r.base_failed and r.score >= 0.5)


def test_odd_texts(spark):
    block = "one two three four five six seven eight"
    texts = [None, "", " \n\t", "a", f"{block} {block}", f"{block} nine\n{block} nine\n{block}", "x\n\nx\n \ny\nx ", "é b 　 c", "#*$%&|<> a|b", "w " * 5000, " ".join(map(str, range(3000))), "a b\x0bc\x0cd\re", f"{block} {block[:-1]}"]
    docs = spark.createDataFrame([(k if k else None, t, 9, "x") for k, t in enumerate(texts)] + [(3, "again", 9, "y")], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    want = sorted([(k if k else None, *plain_counts(t)) for k, t in enumerate(texts)] + [(3, *plain_counts("again"))], key=repr)
    assert sorted([(r.doc_id, *(r[c] for c in quality.BASE)) for r in rows], key=repr) == want
    assert {r.score for r in rows} == {0.5} and all(r.base_failed == failed([r[c] for c in quality.BASE]) for r in rows)  # nothing is labelled
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_windows_of_few_words():
    pick = np.random.default_rng(11)
    for size, vocabulary in ((8, 2), (8, 1), (3, 4), (5, 3)):
        lengths = pick.integers(0, 60, 40)
        codes = pick.integers(0, vocabulary, lengths.sum()).astype(np.int32)
        want, at = [], 0
        for n in lengths.tolist():
            own = codes[at : at + n].tolist()
            seen = Counter(tuple(own[i : i + size]) for i in range(n - size + 1))
            want.append(len({k for i in range(n - size + 1) if seen[tuple(own[i : i + size])] > 1 for k in range(i, i + size)}))
            at += n
        assert quality.covered(codes, lengths, size).tolist() == want


@pytest.fixture(scope="module")
def grown():
    pick = np.random.default_rng(3)
    x = pick.random((3000, len(quality.FEATURES)))
    logit = 3 * x[:, 0] - 4 * x[:, 2] + 2 * np.sin(9 * x[:, 2]) + 2 * (x[:, 5] > 0.5)
    y = (pick.random(3000) < 1 / (1 + np.exp(-logit))).astype(float)
    return x, y, quality.grow(x, y, quality.Settings(trees=30))


def test_flat_trees_against_a_walk(grown):
    x, _, forest = grown
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.start
        for node in forest.roots.tolist():
            while forest.children[node][0] != node:
                node = forest.children[node][int(row[forest.feature[node]] > forest.threshold[node])]
            total += forest.value[node]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_score_is_monotonic_where_asked(grown):
    x, y, forest = grown
    free = quality.grow(x, y, quality.Settings(trees=30, monotonic={}))
    rises = []
    for model in (forest, free):
        scores = []
        for v in np.linspace(0, 1, 60):
            moved = x[:200].copy()
            moved[:, quality.FEATURES.index("symbols")] = v
            scores.append(model.score(moved))
        rises.append(float(np.diff(np.array(scores), axis=0).max()))
    assert rises[0] <= 1e-12 < rises[1]  # the label's own wave does rise


def test_first_split_against_every_split():
    pick = np.random.default_rng(8)
    x, settings = pick.random((300, 3)).round(2), quality.Settings(trees=1, depth=1, bins=200, rate=1.0, monotonic={})
    y = (x[:, 1] + pick.normal(0, 0.2, 300) > 0.6).astype(float)
    forest = quality.grow(x, y, settings)
    p = 1 / (1 + np.exp(-forest.start))
    g, h = p - y, np.full(300, p * (1 - p))
    best = max((sum((g[m].sum()) ** 2 / (h[m].sum() + 2) for m in (x[:, f] <= t, x[:, f] > t)), f, t) for f in range(3) for t in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= t].sum(), h[x[:, f] > t].sum()) >= 2)
    assert (forest.feature[0], forest.threshold[0]) == (best[1], best[2])
    side = x[:, best[1]] <= best[2]
    assert forest.value[1:].tolist() == pytest.approx([-g[m].sum() / (h[m].sum() + 2) for m in (side, ~side)])


def test_held_out_accuracy(spark):
    """Junk and prose are told apart on documents that weren't learnt from."""
    data = "/root/testdata/sf0.01"
    rows = quality.op11_boosted_quality(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where(F.col("quality").isNotNull()).toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.4
