"""Toxicity (operator 3): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The weights are learnt one document at a time with per-coordinate rates and an L1 penalty, so that
almost all of the 2**20 weights stay zero; what is left is broadcast and scored over Arrow batches.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import held_out, table


#: ASCII punctuation.
PUNCTUATION = string.punctuation.encode()


@dataclass(frozen=True)
class Settings:
    """Parameters of the features, of the learner and of its bounded sample."""

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 12
    skip: int = 1  # words left out inside a skip-gram, at most
    pair_value: float = 0.2  # value of a pair's feature; a word's is 1
    least_docs: int = 4  # documents of the sample that a feature needs to be learnt
    sample_rows: int = 12_000  # labelled documents learnt from, about at most
    sample_words: int = 3_000_000  # words learnt from, at most


class Features:
    """Hashed features of texts: words without ASCII punctuation around them, word pairs, and pairs with up to ``skip`` words between.

    A feature is a bucket times 2, plus 1 for pairs, so that both kinds have their own buckets and values.
    """

    WORDS = 400_000  # hashes kept before starting anew

    def __init__(self, settings: Settings):
        self.settings, self.known = settings, {}

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all texts in a row, number of features of each); null and empty texts have none."""
        known, hashes, counts = self.known, [], []
        if len(known) > self.WORDS:
            known.clear()
        for text in texts:
            words = (text or b"").lower().split()
            for w in filterfalse(known.__contains__, {*words}):
                known[w] = xxhash.xxh64_intdigest(w.strip(PUNCTUATION) or w)
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        mask, found = np.uint64((1 << self.settings.bits) - 2), []
        for h in hashes:
            grams = [h]
            for gap in range(1, self.settings.skip + 2):
                if len(h) > gap:
                    grams.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap)) ^ (h[gap:] >> np.uint64(7)) ^ h[gap:])
            g = np.concatenate(grams)
            g ^= g >> np.uint64(31)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(29)
            g &= mask
            g[len(h) :] |= np.uint64(1)
            found.append(g.astype(np.int32))
            counts.append(len(g))
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.array(counts, np.int64)


def learn(texts: list[bytes], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights times values, bias) by FTRL-proximal over presence features, in a fixed shuffled order."""
    flat, counts = Features(settings).of(texts)
    docs = [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
    every, number, known = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    kept = known >= settings.least_docs
    every, place = every[kept], np.where(kept, np.cumsum(kept) - 1, -1)[number]
    docs = [d[d >= 0] for d in np.split(place, np.cumsum([len(d) for d in docs])[:-1])]
    value = np.where(every & 1, settings.pair_value, 1.0)
    values = [value[d] for d in docs]
    z, n = np.zeros(len(every)), np.zeros(len(every))
    zb = nb = bias = 0.0
    weights = lambda i: np.where(np.abs(z[i]) <= settings.l1, 0.0, -(z[i] - np.sign(z[i]) * settings.l1) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2))
    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for k in order.permutation(len(docs)):
            i, x = docs[k], values[k]
            w = weights(i)
            bias = -zb / ((settings.beta + nb**0.5) / settings.alpha)
            slope = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - labels[k]
            g = slope * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / settings.alpha * w
            n[i] = grown
            zb, nb = zb + slope - ((nb + slope * slope) ** 0.5 - nb**0.5) / settings.alpha * bias, nb + slope * slope
    w = weights(slice(None)) * value
    return every[w != 0].astype(np.int32), w[w != 0], float(-zb / ((settings.beta + nb**0.5) / settings.alpha))


def fit(labelled: DataFrame, settings: Settings = Settings()) -> dict:
    """Learns from ``labelled`` (doc_id, text, label): a bounded sample of it in one task, as sparse weights.

    The rows are taken in the order of a hash of the doc_id until ``sample_words`` words are reached
    (the bound of what the task holds; all texts are whole). Rows with a null label are left out.
    Without rows, or with one class only, the model gives the smoothed share.
    """
    rows = labelled.where("label is not null").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string"), F.col("label").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, words = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if words < settings.sample_words:
                    texts.append(text or b"")
                    labels.append(label)
                    words += text.count(b" ") + 1 if text else 0
        y = np.array(labels, float)
        if 0 < y.sum() < len(y):
            i, w, bias = learn(texts, y, settings)
        else:
            share = (y.sum() + 0.5) / (len(y) + 1)
            i, w, bias = np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_pydict({"i": [i], "w": [w], "bias": [bias], "n": [len(texts)]}, pa.schema([("i", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("bias", pa.float64()), ("n", pa.int64())]))

    model = rows.repartition(1).sortWithinPartitions("h", "text").mapInArrow(run, "i array<int>, w array<double>, bias double, n long").first()
    return {"i": np.array(model.i, np.int32), "w": np.array(model.w), "bias": model.bias, "n": model.n, "settings": settings} if model else {"i": np.zeros(0, np.int32), "w": np.zeros(0), "bias": 0.0, "n": 0, "settings": settings}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out`` in [0, 1], from the whole text alone; other columns pass through.

    A feature counts once a document. A null or empty text gets the score of the bias. A column named
    ``out`` is replaced. The weights are at most 2**bits numbers.
    """
    plain = docs.drop(out)
    names, settings = plain.schema.names, model["settings"]
    held = docs.sparkSession.sparkContext.broadcast((model["i"], model["w"], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, bias = held.value
        dense = np.zeros(1 << settings.bits)
        dense[i] = w
        features = Features(settings)
        for batch in batches:
            texts, sums = batch.column(names.index(text)).cast(pa.binary()).to_pylist(), []
            for at in range(0, len(texts), 256):
                flat, counts = features.of(texts[at : at + 256])
                live = np.flatnonzero(dense[flat])
                doc = np.repeat(np.arange(len(counts)), counts)[live]
                seen = np.unique(doc * (1 << settings.bits) + flat[live])
                sums.append(np.bincount(seen >> settings.bits, dense[seen & ((1 << settings.bits) - 1)], len(counts)))
            total = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))], names=[*names, out])

    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{out}` double"
    return plain.mapInArrow(run, full)


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict:
    """The model of the labelled documents that are not held out (crc32(doc_id as text) mod 5 is not 0).

    About ``sample_rows`` labels are kept, by a hash of their doc_id, all if there are fewer; so few can be broadcast.
    """
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = int(min(1.0, settings.sample_rows / max(1, marks.count())) * (1 << 20))
    marks = marks.where(F.col("doc_id").isNotNull() & (F.xxhash64("doc_id").bitwiseAND((1 << 20) - 1) < share))
    learnt = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return fit(learnt, settings)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score and decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents not judged toxic, with their columns."""
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="_toxicity").where("_toxicity < 0.5").drop("_toxicity")
