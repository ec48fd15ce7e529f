"""Quality rules (operator 11): gradient-boosted trees over document statistics.

Statistics are sums over the words of a text: a worker looks at each distinct word once, and texts are
rows of word numbers from then on. The trees are grown on histograms of a bounded sample of labelled
documents, with splits that keep the score monotonic in chosen statistics, and flattened into node arrays
that score a batch of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import held_out, table, written
from gridlight.llm.html_text import STOP_WORDS

#: Words of a repeated window, words that a worker remembers before it starts anew, and bytes of texts that are looked at at once.
WINDOW, CACHE_WORDS, CUT_BYTES = 8, 600_000, 2_000_000
#: The characters that the base counts as symbols, and the last characters of a sentence.
SYMBOLS, ENDS = b"#*$%&|<>", tuple(".!?…\"'”»")
#: What the base of the contract counts.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Properties of a word, in the order of ``word_properties``.
PROPERTIES = ["word_chars", "n_symbols", "letters", "digits", "upper", "stop", "end", "wordy", "shouted", "exclaimed", "foreign", "long"]


@dataclass(frozen=True)
class Settings:
    """Trees, and the signs of the statistics in which the score may only fall (-1) or rise (1).

    ``sample_rows`` bounds the labelled documents that are learnt from: their statistics are what one
    place holds.
    """

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 2.0
    least_weight: float = 2.0  # sum of second derivatives in a leaf
    sample_rows: int = 20_000
    monotonic: dict[str, int] = field(default_factory=lambda: {"symbols": -1, "dup_lines": -1, "repeated": -1, "adjacent": -1, "wordless": -1, "shouted": -1, "exclaimed": -1})


def word_properties(word: bytes) -> tuple:
    """The numbers named by ``PROPERTIES`` for one word."""
    said = word.decode("utf-8", "replace")
    letters, low = sum(map(str.isalpha, said)), said.lower()
    upper = 0 if low == said else sum(map(str.isupper, said))
    bare = low.strip(".,;:!?\"'()[]«»„“”…")
    return (
        len(said), len(word) - len(word.translate(None, SYMBOLS)), letters, sum(map(str.isdigit, said)), upper, bare in STOP_WORDS, said.endswith(ENDS), letters > 0,
        upper > 1 and upper == letters, said.count("!") + said.count("?"), len(said) - len(said.encode("ascii", "ignore")), len(said) > 25,
    )


def covered(codes: np.ndarray, lengths: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words are in windows of ``size`` words that it has twice or more.

    ``codes`` has the word numbers of all texts, one after another. Windows are sorted by a hash; those
    of one hash are compared word by word, and should two differ, all windows are ranked without hashes.
    """
    ends = np.cumsum(lengths)
    out = np.zeros(len(lengths), np.int64)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - size + 1, 0))
    if not len(doc):
        return out
    n = np.maximum(lengths - size + 1, 0)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + (ends - lengths)[doc]
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        h = (h ^ mixed[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    twin = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    first, second = at[order[twin]], at[order[twin + 1]]
    if not all(np.array_equal(codes[first + k], codes[second + k]) for k in range(size)) or not np.array_equal(doc[order[twin]], doc[order[twin + 1]]):
        rank, width = codes.astype(np.int64), 1  # ranks of windows of 1, 2, 4 and so on words, without hashes
        while width < size:
            step = min(width, size - width)
            pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
            rank, width = np.unique(pair, return_inverse=True)[1], width + step
        _, which, count = np.unique(doc * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
        repeated = at[count[which] > 1]
    else:
        repeated = np.unique(np.concatenate([first, second]))
    edge = np.bincount(repeated, minlength=len(codes) + 1).astype(np.int64)
    edge[size:] -= np.bincount(repeated, minlength=len(codes) + 1)[: len(edge) - size]
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[ends] - inside[ends - lengths]


class Statistics:
    """Counts words and lines of texts; keeps what it knows of words."""

    #: The columns that ``of`` gives after the base.
    NAMES = ["letters", "digits", "upper", "stop", "end", "wordy", "shouted", "exclaimed", "foreign", "long", "distinct", "adjacent", "n_lines", "ended_lines"]

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.properties = np.zeros((0, len(PROPERTIES)), np.int32)

    def of(self, texts: list[bytes]) -> np.ndarray:
        """(texts, BASE and NAMES) counts as 64-bit integers."""
        if len(self.codes) > CACHE_WORDS:
            self.__init__()
        split = [t.split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for s in split for w in s]
        new = [*filterfalse(self.codes.__contains__, dict.fromkeys(flat))]
        if new:
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
            self.properties = np.concatenate([self.properties, np.array([*map(word_properties, new)], np.int32)])
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int32, len(flat))
        out = np.zeros((len(texts), len(BASE) + len(self.NAMES)), np.int64)
        out[:, 0] = lengths
        full = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[full]
        sums = {}
        if len(full):
            for k, name in enumerate(PROPERTIES):
                sums[name] = np.zeros(len(texts), np.int64)
                sums[name][full] = np.add.reduceat(self.properties[:, k][codes], starts, dtype=np.int64)
            same = np.concatenate([[0], (codes[1:] == codes[:-1]).astype(np.int64)])
            same[starts] = 0
            sums["adjacent"] = np.zeros(len(texts), np.int64)
            sums["adjacent"][full] = np.add.reduceat(same, starts)
            doc = np.repeat(np.arange(len(texts)), lengths)
            once = np.unique(doc * len(self.codes) + codes)
            sums["distinct"] = np.bincount(once // len(self.codes), minlength=len(texts))
        for name, values in sums.items():
            out[:, (BASE + self.NAMES).index(name)] = values
        out[:, 4] = covered(codes, lengths)
        for k, t in enumerate(texts):
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            ended = sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines)
            out[k, 3] = len(lines) - len({*lines})
            out[k, -2:] = len(lines), ended
        return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts ``BASE`` and ``Statistics.NAMES`` as long columns; a null text counts as empty.

    Other columns pass through; those named as counts are replaced. Every text is counted whole.
    """
    counts = BASE + Statistics.NAMES
    plain = docs.select(*(c for c in docs.columns if c not in {text, *counts}), F.col(text).cast("string").alias("_text"))
    names = plain.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Statistics()
        for batch in batches:
            texts, found, at = [t or b"" for t in batch.column(names.index("_text")).cast(pa.binary()).to_pylist()], [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < CUT_BYTES:
                    size += len(texts[end])
                    end += 1
                found.append(made.of(texts[at:end]))
                at = end
            rows = np.concatenate(found) if found else np.zeros((0, len(counts)), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in names if n != "_text"), *(pa.array(rows[:, k]) for k in range(len(counts)))], names=[*(n for n in names if n != "_text"), *counts])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "_text"), *(f"{c} long" for c in counts)])
    return plain.mapInArrow(run, schema)


#: What the trees see: shares and means of the counts.
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeated", "stop", "letters", "digits", "upper", "ended_lines", "distinct", "adjacent", "line_length", "ends", "wordless", "shouted", "exclaimed", "foreign", "long"]


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, FEATURES) from counts by name; nothing is divided by zero, so a text without words has plain zeros."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = (np.maximum(1, c[k]) for k in ("n_words", "word_chars", "n_lines"))
    columns = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["stop"] / words, c["letters"] / chars,
        c["digits"] / chars, c["upper"] / np.maximum(1, c["letters"]), c["ended_lines"] / lines, c["distinct"] / words, c["adjacent"] / words, np.log1p(c["n_words"] / lines), c["end"] / words,
        1 - c["wordy"] / words, c["shouted"] / words, c["exclaimed"] / words, c["foreign"] / chars, c["long"] / words,
    ]
    return np.stack(columns, 1)


@dataclass
class Forest:
    """Trees as node arrays: a leaf's children are itself, so a walk of ``depth`` steps ends in a leaf of every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # (nodes, 2): where the value is at most the threshold, and else
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            node = self.children[node, (x[rows, self.feature[node]] > self.threshold[node]).astype(np.int8)]
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[node].sum(1), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Boosted trees of labels ``y`` (0 or 1) by features ``x``, level by level on histograms of quantile bins.

    A split by a monotonic feature is only taken where its sides' values are ordered as the sign says,
    and bounds the values below either side by their middle, so no later split undoes the order.
    """
    rows, width = x.shape
    sign = np.array([settings.monotonic.get(f, 0) for f in FEATURES[:width]])
    share = (y.sum() + 0.5) / (rows + 1)
    start = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if 0 < y.sum() < rows:
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, settings.bins) / settings.bins, method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        bins = max(len(c) for c in cuts) + 1
        total = np.full(rows, start)
        for _ in range(settings.trees):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            at = np.full(rows, len(nodes))
            roots.append(len(nodes))
            level = [(len(nodes), -np.inf, np.inf)]
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            for depth in range(settings.depth + 1):
                index = {n: k for k, (n, _, _) in enumerate(level)}
                spot = np.array([index.get(n, -1) for n in range(len(nodes))])[at]
                live = np.flatnonzero(spot >= 0)
                cell = (spot[live, None] * width + np.arange(width)) * bins + binned[live]
                shape = (len(level), width, bins)
                hg, hh = (np.bincount(cell.ravel(), np.repeat(v[live], width), np.prod(shape)).reshape(shape).cumsum(2) for v in (g, h))
                later = []
                for k, (n, low, high) in enumerate(level):
                    gg, hs = hg[k, 0, -1], hh[k, 0, -1]
                    nodes[n][4] = settings.rate * float(np.clip(-gg / (hs + settings.ridge), low, high))
                    if depth == settings.depth:
                        continue
                    gl, hl = hg[k][:, :-1], hh[k][:, :-1]
                    gr, hr = gg - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + settings.ridge), low, high), np.clip(-gr / (hr + settings.ridge), low, high)
                    gain = gl**2 / (hl + settings.ridge) + gr**2 / (hr + settings.ridge) - gg**2 / (hs + settings.ridge)
                    allowed = (hl >= settings.least_weight) & (hr >= settings.least_weight) & (sign[:, None] * (vr - vl) >= 0)
                    gain = np.where(allowed, gain, 0)
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] <= 1e-9 or b >= len(cuts[f]):
                        continue
                    middle, sides = (vl[f, b] + vr[f, b]) / 2, [[low, high], [low, high]]
                    if sign[f]:
                        sides[0][1 if sign[f] > 0 else 0] = sides[1][0 if sign[f] > 0 else 1] = middle
                    children = [len(nodes), len(nodes) + 1]
                    nodes[n][:4] = [f, float(cuts[f][b]), *children]
                    for c, s in zip(children, sides):
                        nodes.append([0, np.inf, c, c, 0.0])
                        later.append((c, *s))
                    own = live[spot[live] == k]
                    at[own] = np.where(binned[own, f] <= b, *children)
                level = later
                if not level:
                    break
            total += np.array([n[4] for n in nodes])[at]
    columns = [*zip(*nodes)] or [()] * 5
    children = np.array(columns[2:4], np.int32).reshape(2, -1).T
    return Forest(np.array(columns[0], np.int32), np.array(columns[1], float), np.ascontiguousarray(children), np.array(columns[4], float), np.array(roots, np.int32), settings.depth, start)


def fit(counted: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Forest:
    """The trees of the labelled documents of ``counted`` (doc_id and counts) that are not held out (crc32(doc_id as text) mod 5 is not 0).

    ``labels`` has doc_id and quality (1 is good); of a repeated doc_id the lower one holds. About
    ``sample_rows`` labels are kept, by a hash of their doc_id, all if there are fewer. Without rows, or
    with one class only, the score is the smoothed share of the good ones.
    """
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out(0)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("_label"))
    share = int(min(1.0, settings.sample_rows / max(1, marks.count())) * (1 << 20))
    marks = marks.where(F.xxhash64("doc_id").bitwiseAND((1 << 20) - 1) < share)
    counts = BASE + Statistics.NAMES
    rows = counted.join(F.broadcast(marks), "doc_id").select("doc_id", "_label", *counts).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()  # about sample_rows
    return grow(features({c: rows[c].to_numpy() for c in counts}), rows["_label"].to_numpy().astype(float), settings)


def score(counted: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """``counted`` with a double column ``out``, the probability of good quality; one of that name is replaced."""
    plain = counted.drop(out)
    names, counts = plain.schema.names, BASE + Statistics.NAMES
    held = counted.sparkSession.sparkContext.broadcast(forest)  # at most trees * 2 ** (depth + 1) nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(names.index(c)).to_numpy() for c in counts})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(x))], names=[*names, out])

    return plain.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{out}` double")


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text and more) without texts, with the counts, base_failed, held_out, score and kept.

    base_failed: under 20 words, or more than 30 % of them in repeated windows of 8. kept: not
    base_failed, and a score of at least 0.5. Null and empty texts have no words and fail. Null and
    repeated doc_ids are judged as any row; columns of ``docs`` named as those added are replaced.
    """
    counted = written(statistics(docs), "statistics")
    scored = score(counted, fit(counted, labels, settings))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumns({"base_failed": failed, "held_out": held_out(0), "kept": ~failed & (F.col("score") >= 0.5)})


def op11_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and decision for every document."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "score", "held_out")
