"""Language-model scoring (operator 1): a causal self-attention model over subword ids, trained and run in numpy.

A text is its lower-cased words, each spelled in subword ids that begin with a space, and one end id. The
ids are the most frequent subwords of a public byte-level vocabulary, all others being spelled in as few of
these and of bytes as can be, so every word has exactly one spelling. The model reads the ids of a whole text in overlapping windows and
scores each id once, from the ids before it in the window; a text's score is the sum over its ids.

One model is trained, on every id of every training text: in a few rounds each task trains on its blocks'
share of documents from the round's parameters, and the tasks' parameters are averaged by their numbers
of targets. The output biases begin as the subword counts of the whole training corpus.

Documents travel in blocks of a few MB, as word codes with the spellings of a block's distinct words. Word
counts are exchanged between blocks as packed arrays of hashes and counts, each bucket of hashes summed up
by one task; no word table is held anywhere.
"""

from __future__ import annotations

import base64
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import held_out, table, written


@dataclass(frozen=True)
class Settings:
    """Sizes of the model, of its training and of the blocks."""

    size: int = 24  # of embeddings
    hidden: int = 32  # units between attention and output
    window: int = 32  # ids that a window sees
    stride: int = 24  # ids that it scores: the last ones
    classes: int = 32  # of the two-level output; as many subwords in each
    batch: int = 128  # windows a training step
    rate: float = 0.03
    rounds: int = 6  # of averaging, over which the documents of a pass are spread
    least_targets: int = 6_000_000  # small corpora are passed over several times, until about so many ids are trained on
    most_passes: int = 8
    block_bytes: int = 8_000_000

    @property
    def ids(self) -> int:
        return self.classes * self.classes

    def passes(self, targets: int) -> int:
        return min(self.most_passes, max(1, -(-self.least_targets // max(1, targets))))


#: Reserved ids: the end of a text, which also stands before its begin; from BYTES on the 256 bytes. Subwords follow.
END, BYTES = 0, 1


class Attention:
    """One layer of causal self-attention with a two-level softmax; ``flat`` has all parameters, ``p`` views of it by name.

    Weights that have biases lie with them in one view, the biases as the last row: what they are applied to has ones as its last column.
    """

    def __init__(self, settings: Settings, flat: np.ndarray | None = None, slots: np.ndarray | None = None):
        s, self.s = settings, settings
        self.slots = np.arange(s.ids, dtype=np.int32) if slots is None else slots  # of ids at the output: class * classes + place in the class
        d, c = s.size, s.classes
        shapes = {"e": (s.ids, d), "before": (s.ids, d), "v": (s.ids, d), "q": (d, d), "k": (d, d), "near": (s.window,), "m1_mb": (d + 1, s.hidden), "m2": (s.hidden, d), "c_cb": (d + 1, c), "i_ib": (c, d + 1, c)}
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes.values())])
        self.places = dict(zip(shapes, zip(ends[:-1].tolist(), ends[1:].tolist(), shapes.values())))
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat
        self.p = self.views(self.flat)
        if flat is None:
            rng, scale = np.random.default_rng(7), {"e": 0.5, "before": 0.3, "v": 0.5, "q": 1.0, "k": 1.0, "m1": 1.0, "m2": 0.1, "c": 0.3, "i": 0.3}
            for k in ("e", "before", "v", "q", "k", "near", "m1", "mb", "m2", "c", "cb", "i", "ib"):
                self.p[k][:] = scale.get(k, 0.0) * rng.normal(0, d**-0.5, self.p[k].shape)
        self.moments, self.steps, self.trained = None, 0, 0
        back = np.arange(s.window - s.stride, s.window)[:, None] - np.arange(s.window)
        self.back, self.seen = np.clip(back, 0, None), back >= 0
        self.ones = np.ones(max(c, s.window), np.float32)
        self.e_one, self.before_none = (np.full((s.ids, d + 1), x, np.float32) for x in (1, 0))
        self.m2_none = np.zeros((s.hidden, d + 1), np.float32)
        self.each = np.zeros((0, s.window, 5 * d), np.float32)
        self.prepare()

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        p = {k: flat[low:high].reshape(shape) for k, (low, high, shape) in self.places.items()}
        for both in ("m1_mb", "c_cb", "i_ib"):
            weights, biases = both.split("_")
            p[weights], p[biases] = p[both][..., :-1, :], p[both][..., -1, :]
        return p

    def prepare(self) -> None:
        """What each id contributes as query and key, what has a last column added, and the causal mask with its distance weights."""
        p, d = self.p, self.s.size
        self.queries, self.keys = p["e"] @ (p["q"] / np.float32(d**0.5)), p["e"] @ p["k"]
        self.e_one[:, :d], self.before_none[:, :d], self.m2_none[:, :d] = p["e"], p["before"], p["m2"]
        self.mask = np.where(self.seen, np.exp(p["near"])[self.back], np.float32(0))

    def begin(self, counts: np.ndarray) -> None:
        """Sets the output biases to the log frequencies of the ids."""
        c = self.s.classes
        seen = np.empty(self.s.ids)
        seen[self.slots] = counts + 0.1
        seen = seen.reshape(c, c)
        self.p["cb"][:] = np.log(seen.sum(1) / seen.sum())
        self.p["ib"][:] = np.log(seen / seen.sum(1, keepdims=True))

    def attend(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Hidden states (n * stride, size and a one) of the last ``stride`` positions of windows (n, window), and what the gradient needs."""
        p, s, d = self.p, self.s, self.s.size
        ids = ids.astype(np.intp)
        last, before = ids[:, -s.stride :], ids[:, -s.stride - 1 : -1]
        q, k, v = self.queries.take(last, 0), self.keys.take(ids, 0), p["v"].take(ids, 0)
        a = q @ k.transpose(0, 2, 1)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(a, out=a)
            a *= self.mask
            total = a.reshape(-1, s.window) @ self.ones[: s.window]
        if not self._held(total):
            a = q @ k.transpose(0, 2, 1)
            self._shift(a)
            np.exp(a, out=a)
            a *= self.mask
            total = a.reshape(-1, s.window) @ self.ones[: s.window]
        share = (1 / total).reshape(len(ids), s.stride, 1)
        mixed = a @ v
        mixed *= share
        h = self.e_one.take(last, 0)
        h[:, :, :d] += mixed
        h += self.before_none.take(before, 0)
        h = h.reshape(-1, d + 1)
        z = h @ p["m1_mb"]
        np.maximum(z, np.zeros_like(z), out=z)  # faster than with a scalar
        hidden = z @ self.m2_none
        hidden += h
        return hidden, (ids, q, k, v, a, share, mixed, h, z)

    @staticmethod
    def _held(sums: np.ndarray) -> bool:
        """Whether sums of exponentials have neither overflown nor vanished."""
        return bool(sums.min(initial=1) > 1e-30 and sums.max(initial=1) < 1e30)

    @staticmethod
    def _shift(x: np.ndarray) -> None:
        """Moves each row of logits to at most 0 and at least -60; a shift of a row changes nothing."""
        x -= x.max(-1, keepdims=True)
        np.maximum(x, -60, out=x)

    def _level(self, made: Callable[[], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exponentials, log-probabilities of the places ``at``, one of each row, sums of rows) of the logits that ``made`` gives."""
        x = made()
        logs = x.reshape(-1).take(at)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(x, out=x)
            total = x @ self.ones[: x.shape[1]]
        if not self._held(total):
            x = made()
            self._shift(x)
            logs = x.reshape(-1).take(at)
            np.exp(x, out=x)
            total = x @ self.ones[: x.shape[1]]
        logs -= np.log(total)
        return x, logs, total

    def log_probabilities(self, hidden: np.ndarray, targets: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ``targets`` (n), 0 for those below 0, from ``hidden``; with ``gradient``, adds to it and gives d(-sum)/d(hidden).

        The first level chooses the class, the second the id in it. Rows are laid out by class, so that
        the second level is one product for each class.
        """
        p, c, d = self.p, self.s.classes, self.s.size
        scored = np.flatnonzero(targets >= 0)
        which, inner = np.divmod(self.slots.take(targets.take(scored)), np.int32(c))
        by = np.argsort(which.astype(np.uint16), kind="stable")
        order, which = scored.take(by), which.take(by)
        ends = np.cumsum(np.bincount(which, minlength=c)).tolist()
        parts = [(k, slice(low, high)) for k, (low, high) in enumerate(zip([0, *ends], ends)) if high > low]
        h, rows = hidden.take(order, 0), np.arange(0, len(order) * c, c)

        def second() -> np.ndarray:
            x = np.empty((len(h), c), np.float32)
            for k, part in parts:
                np.matmul(h[part], p["i_ib"][k], out=x[part])
            return x

        at = rows + which
        x, logs, total = self._level(lambda: h @ p["c_cb"], at)
        out, back = np.zeros(len(targets), np.float32), None
        if gradient is not None:
            x *= (1 / total)[:, None]
            x.reshape(-1)[at] -= 1
            found = x @ p["c"].T
            gradient["c_cb"] += h.T @ x
        at = rows + inner.take(by)
        x, more, total = self._level(second, at)
        out[order] = logs + more
        if gradient is not None:
            x *= (1 / total)[:, None]
            x.reshape(-1)[at] -= 1
            for k, part in parts:
                found[part] += x[part] @ p["i"][k].T
                gradient["i_ib"][k] += h[part].T @ x[part]
            back = np.zeros((len(targets), d), np.float32)
            back[order] = found
        return out, back

    def ones_of(self, n: int) -> np.ndarray:
        if n > len(self.ones):
            self.ones = np.ones(n, np.float32)
        return self.ones[:n]

    @classmethod
    def _by_id(cls, ids: np.ndarray, x: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(distinct ids, the sums of the rows of ``x`` of each).

        Rows are laid out by their number among the rows of their id, and then by the ids, the most
        frequent first: the rows of a number are added at once to the front of the sums. An id of more
        than ``most`` rows is summed up in parts of so many, and these the same way.
        """
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        at = ids.take(order)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        distinct = len(first)
        number = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) if distinct else first
        number %= most
        first = np.flatnonzero((number == 0))
        sizes = np.diff(np.append(first, len(at)))
        ranked = np.argsort((most - sizes).astype(np.uint16), kind="stable")
        place = np.empty(len(first), np.intp)
        place[ranked] = np.arange(len(first))
        layers = len(first) - np.cumsum(np.bincount(sizes))[:-1]  # how many parts have more rows than 0, 1, ...
        starts = np.cumsum(layers) - layers
        laid_out = np.empty(len(at), np.intp)
        laid_out[starts.take(number) + np.repeat(place, sizes)] = order
        x = x.take(laid_out, 0)
        sums = x[: len(first)]
        for low, n in zip(starts[1:].tolist(), layers[1:].tolist()):
            sums[:n] += x[low : low + n]
        found = at.take(first.take(ranked))
        return (found, sums) if distinct == len(first) else cls._by_id(found, sums, most)

    def gradient(self, ids: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of -log p, its gradient in the order of ``flat``) over windows; a target below 0 is not scored."""
        p, s, n = self.p, self.s, len(ids)
        out = np.zeros_like(self.flat)
        g, d = self.views(out), s.size
        hidden, (ids, q, k, v, a, share, mixed, h, z) = self.attend(ids)
        logs, dh = self.log_probabilities(hidden, targets.reshape(-1), g)
        dz = dh @ p["m2"].T
        dz *= z > 0
        g["m2"] += z.T @ dh
        g["m1_mb"] += h.T @ dz
        dh += dz @ p["m1"].T
        dh = dh.reshape(n, s.stride, d)
        # the weights of the attention aren't divided by their sums, so what comes back to them is
        shared = dh * share
        mixed *= shared
        da = shared @ v.transpose(0, 2, 1)
        da -= (mixed.reshape(-1, d) @ self.ones_of(d)).reshape(n, s.stride, 1)
        da *= a
        near = (self.ones_of(n) @ da.reshape(n, -1)).reshape(s.stride, s.window)
        g["near"] += np.bincount(self.back[self.seen], near[self.seen], s.window).astype(np.float32)
        # what each position of a window gives to its id's row of "v", as key, as query, of "e" and of "before"
        if len(self.each) < n:
            self.each = np.zeros((n, s.window, 5 * d), np.float32)
        each = self.each[:n]
        each[:, :, :d] = a.transpose(0, 2, 1) @ shared
        each[:, :, d : 2 * d] = da.transpose(0, 2, 1) @ q
        each[:, -s.stride :, 2 * d : 3 * d] = da @ k
        each[:, -s.stride :, 3 * d : 4 * d] = dh
        each[:, -s.stride - 1 : -1, 4 * d :] = dh
        found, sums = self._by_id(ids.reshape(-1), each.reshape(-1, 5 * d))
        g["v"][found], dk, dq, de, g["before"][found] = (sums[:, j * d : (j + 1) * d] for j in range(5))
        dq = dq / np.float32(d**0.5)
        e = p["e"].take(found, 0)
        g["q"] += e.T @ dq
        g["k"] += e.T @ dk
        g["e"][found] = de + dq @ p["q"].T + dk @ p["k"].T
        return -float(logs.sum()), out

    def train(self, ids: np.ndarray, targets: np.ndarray, rate: float) -> None:
        """One pass of Adam over windows in a shuffled order; its moments go on from the call before."""
        if self.moments is None:
            self.moments = np.zeros_like(self.flat), np.zeros_like(self.flat)
        first, second = self.moments
        step = np.empty_like(self.flat)
        order = np.random.default_rng(self.steps).permutation(len(ids))
        for at in np.array_split(order, max(1, round(len(ids) / self.s.batch))):
            wanted = targets[at]
            n = int((wanted >= 0).sum())
            if not n:
                continue
            _, g = self.gradient(ids[at], wanted)
            self.steps, self.trained = self.steps + 1, self.trained + n
            g *= np.float32(0.1 / n)
            first *= np.float32(0.9)
            first += g
            g *= g
            second *= np.float32(0.99)
            second += g
            np.sqrt(second, out=step)
            step *= np.float32((1 - 0.99**self.steps) ** -0.5)
            step += np.float32(1e-8)
            np.divide(first, step, out=step)
            step *= np.float32(rate * min(1, self.steps / 20) / (1 - 0.9**self.steps))
            self.flat -= step
            self.prepare()

    def score(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target of the windows, 0 for those below 0, in batches of bounded size."""
        values = np.zeros(targets.shape, np.float32)
        for at in range(0, len(ids), self.s.batch):
            hidden, _ = self.attend(ids[at : at + self.s.batch])
            values[at : at + self.s.batch] = self.log_probabilities(hidden, targets[at : at + self.s.batch].reshape(-1))[0].reshape(-1, self.s.stride)
        return values


def windows_of(sequence: np.ndarray, lengths: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of ids, their targets or -1) of texts laid end to end, each with its END: a window's targets follow its last ``stride`` ids."""
    count = -(-lengths // stride)
    lead, sizes = window - stride, (window - stride) + count * stride
    starts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    inputs, wanted = np.full(total + 1, END, np.int16), np.full(total, -1, np.int16)
    place = np.repeat(starts + lead - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(sequence))
    inputs[place + 1] = sequence
    inputs[starts + lead] = END  # in place of the id that the text before may have put there
    wanted[place] = sequence
    first = np.repeat(starts - stride * (np.cumsum(count) - count), count) + stride * np.arange(int(count.sum()))
    at = first[:, None] + np.arange(window)
    return inputs[at], wanted[at[:, lead:]]


def rank_file(path: str | None = None) -> list[tuple[bytes, int]]:
    """(bytes, rank) of a rank file; by default the 50k vocabulary for many languages."""
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


@lru_cache(1)
def _encoding(path: str | None) -> tuple[tiktoken.Encoding, list[bytes], np.ndarray]:
    """(encoder of words with a space before each, the bytes of every rank, whether they begin with a space)."""
    ranks = dict(rank_file(path))
    names = [b""] * (max(ranks.values()) + 1)
    for name, rank in ranks.items():
        names[rank] = name
    return tiktoken.Encoding("words", pat_str=" ?[^ ]+", mergeable_ranks=ranks, special_tokens={}), names, np.array([n[:1] == b" " for n in names])


def spell(words: list[bytes], path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of all words in a row, number of each); every word begins with a rank that begins with a space, and no other does."""
    encoder, _, begins = _encoding(path)
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    parts = []
    for at in range(0, len(words), 20_000):
        parts.append(encoder.encode_to_numpy(" " + b" ".join(words[at : at + 20_000]).decode("utf-8", "replace"), disallowed_special=()).astype(np.uint16))
    ranks = np.concatenate(parts)
    starts = np.flatnonzero(begins[ranks])
    return ranks, np.diff(np.append(starts, len(ranks)))


class Ids:
    """The model's ids of ranks: the kept ranks have an id each, all others are spelled in as few of these and of bytes as can be."""

    def __init__(self, kept: list[int], names: list[bytes]):
        number = {names[rank]: BYTES + 256 + k for k, rank in enumerate(kept)}
        longest = max(map(len, number), default=1)
        spelled = [self._spelled(name, number, longest) for name in names]
        self.sizes = np.array([len(x) for x in spelled], np.int32)
        self.starts, self.ids = np.cumsum(self.sizes) - self.sizes, np.array([i for x in spelled for i in x], np.int16)

    @staticmethod
    def _spelled(name: bytes, number: dict[bytes, int], longest: int) -> list[int]:
        if name in number:
            return [number[name]]
        fewest, begins = [0], [0]  # ids of the first 0, 1, ... bytes, and where the last of them begins
        for end in range(1, len(name) + 1):
            most, begin = fewest[end - 1] + 1, end - 1
            for at in range(max(0, end - longest), end - 1):
                if fewest[at] + 1 < most and name[at:end] in number:
                    most, begin = fewest[at] + 1, at
            fewest.append(most)
            begins.append(begin)
        ids, end = [], len(name)
        while end:
            part = name[begins[end] : end]
            ids.append(number[part] if part in number else BYTES + part[0])
            end = begins[end]
        return ids[::-1]

    def of(self, ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words in a row, number of each) for their ``ranks`` in a row, of which each word has ``sizes``."""
        if not len(ranks):
            return np.zeros(0, np.int16), np.zeros(0, np.int64)
        each = self.sizes[ranks]
        return laid(self.ids, self.starts[ranks], each), np.add.reduceat(each, np.cumsum(sizes) - sizes).astype(np.int64)


def laid(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` from ``starts``, of ``sizes``, one after another."""
    return values.take(np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())))


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _buckets_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and hash, ends of the buckets in it)."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


BLOCK = "kind int, block string, bucket int, ids binary, marks binary, lengths binary, codes binary, ranks binary, sizes binary, seen binary, hashes binary, counts binary"


def blocks(docs: DataFrame, buckets: int, path: str | None, settings: Settings) -> DataFrame:
    """``docs`` (doc_id, held, text) as blocks, written once.

    A block's row of kind 0 has its ids, marks (1: held out, 2: null id), numbers of tokens, codes of the
    tokens (0: end), spellings of the distinct words in ranks, and numbers of each rank in its training
    texts. Rows of kind 1 have, for each bucket of word hashes, the places of its distinct words by hash
    order and their counts in training texts.
    """

    def rows(name: str, ids: list, marks: list, texts: list[bytes]) -> Iterator[pd.DataFrame]:
        number: defaultdict = defaultdict(itertools.count(1).__next__)
        listed = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in (t.lower().split() for t in texts)]
        lengths = np.array([len(x) + 1 for x in listed], np.int64)
        codes = np.zeros(int(lengths.sum()), np.int32)
        body = np.ones(len(codes), bool)
        body[np.cumsum(lengths) - 1] = False
        codes[body] = np.concatenate(listed)
        words = list(number)
        training = np.repeat((np.array(marks) & 1) == 0, lengths) & body
        counts = np.bincount(codes[training], minlength=len(words) + 1)[1:]
        ranks, sizes = spell(words, path)
        seen = np.bincount(ranks, np.repeat(counts, sizes), len(_encoding(path)[1])).astype(np.int64)
        unsorted = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        order, ends = _buckets_of(unsorted, buckets)
        hashes, counts = unsorted[order], counts[order].astype("<i8")
        out = [(0, name, -1, np.array(ids, "<i8").tobytes(), np.array(marks, np.uint8).tobytes(), lengths.tobytes(), _pack(codes), _pack(ranks), _pack(sizes.astype(np.int32)), _pack(seen), _pack(unsorted), None)]
        out += [(1, name, k, *[None] * 7, hashes[low:high].tobytes(), counts[low:high].tobytes()) for k, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if high > low]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in map(str.split, BLOCK.split(", "))])
        made, task = itertools.count(), TaskContext.get().partitionId()
        ids, marks, texts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for frame in rows(f"{task}-{next(made)}", ids, marks, texts):
                yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

        for batch in batches:
            for i, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                ids.append(i or 0)
                marks.append(bool(held) + 2 * (i is None))
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= settings.block_bytes or len(ids) >= 100_000:
                    yield from flush()
                    ids, marks, texts, size = [], [], [], 0
        if ids:
            yield from flush()

    return written(docs.mapInArrow(run, BLOCK), "blocks")


def word_counts(made: DataFrame) -> DataFrame:
    """(block, bucket, counts, total, distinct): each block's words' counts in the whole training corpus, in the order of their hashes.

    One task sums up a bucket of hashes over all blocks; ``total`` and ``distinct`` are the bucket's own, on its first row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        number = np.concatenate([np.frombuffer(x, "<i8") for x in rows["counts"]])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        summed = np.bincount(at, number).astype("<i8")
        back, ends = summed[at], np.cumsum([len(h) for h in hashes]).tolist()
        first = [True] + [False] * (len(rows) - 1)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "counts": [back[e - len(h) : e].tobytes() for e, h in zip(ends, hashes)], "total": [int(summed.sum()) if f else 0 for f in first], "distinct": [int((summed > 0).sum()) if f else 0 for f in first]})

    return written(made.where("kind = 1").select("block", "bucket", "hashes", "counts").groupBy("bucket").applyInPandas(run, "block string, bucket int, counts binary, total long, distinct long"), "counts")


VECTOR = pa.schema([("task", pa.int64()), ("v", pa.binary())])


def _vector(x: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([x.astype(float).tobytes()], pa.binary())], schema=VECTOR)


def _total(rows: DataFrame, tasks: int, fan: int = 32) -> np.ndarray | None:
    """The sum of packed vectors of doubles, a row (task, v) a task: ``fan`` at a time in tasks, until one is left; None without rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, total = part.sort_values("task"), 0.0
        for v in part["v"]:
            total = total + np.frombuffer(v)
        return pd.DataFrame({"task": [int(part["task"].iloc[0]) // fan], "v": [total.tobytes()]})

    while True:
        rows, tasks = rows.groupBy(F.floor(F.col("task") / fan).alias("g")).applyInPandas(run, "task long, v binary"), -(-tasks // fan)
        if tasks <= 1:
            found = rows.first()
            return np.frombuffer(bytes(found.v)) if found else None


class Block:
    """A block's tokens as the model's ids."""

    def __init__(self, lengths: bytes, codes: bytes, ranks: bytes, sizes: bytes, ids: Ids):
        self.lengths, self.codes = np.frombuffer(lengths, np.int64), _unpack(codes, np.int32)
        flat, each = ids.of(_unpack(ranks, np.uint16), _unpack(sizes, np.int32))
        self.flat, self.each = np.append(np.int16(END), flat), np.append(1, each)
        self.starts = np.cumsum(self.each) - self.each
        self.ends = np.cumsum(self.lengths)

    def parts(self, docs: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, ids in a row, number of each) for ``docs``, in parts of about ``most`` tokens; a longer text is one."""
        if not len(docs):
            return
        sizes = self.lengths[docs]
        group = np.cumsum(sizes) // most
        for part in np.split(docs, np.flatnonzero(np.diff(group)) + 1):
            n = self.lengths[part]
            codes = laid(self.codes, self.ends[part] - n, n)
            each = self.each[codes]
            yield part, laid(self.flat, self.starts[codes], each), np.add.reduceat(each, np.cumsum(n) - n)


def _place(n: int) -> np.ndarray:
    """A fixed place in [0, 1) for each of n documents, evenly spread."""
    return (np.arange(n, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32)).astype(float) / (1 << 32)


def fit(made: DataFrame, path: str | None, settings: Settings = Settings()) -> dict:
    """{ids, parameters, slots, tokens}: how ranks are spelled and the model, from all training texts of the blocks ``made``.

    Every pass trains on every id of every training text. A pass is spread over rounds; in a round a
    task trains on its blocks' documents of that round, beginning with the round's parameters, and the
    averages of what the tasks come to, weighted by their targets, are the next round's.
    """
    whole = made.where("kind = 0")
    spark, tasks, names = made.sparkSession, whole.rdd.getNumPartitions(), _encoding(path)[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for seen, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.append(_unpack(seen, np.int64), ((np.frombuffer(marks, np.uint8) & 1) == 0).sum())
                found = more if found is None else found + more
        if found is not None:
            yield _vector(found)

    counted = _total(whole.select("seen", "marks").mapInArrow(count, "task long, v binary"), tasks)
    seen, texts = (counted[:-1], counted[-1]) if counted is not None else (np.zeros(len(names)), 0)
    order = np.lexsort((np.arange(len(seen)), -seen))
    kept = [int(r) for r in order if seen[r] > 0][: settings.ids - BYTES - 256]
    model, ids = Attention(settings), Ids(kept, names)
    frequency = np.bincount(ids.ids, np.repeat(seen, ids.sizes), settings.ids)
    frequency[END] += texts
    if not texts:
        return {"ids": ids, "parameters": model.flat, "slots": model.slots, "tokens": 0}
    # ids to classes of about equal frequency: dealt from the most frequent on, to and fro
    c, ranked = settings.classes, np.empty(settings.ids, np.int32)
    ranked[np.argsort(-frequency, kind="stable")] = np.arange(settings.ids)
    turn, place = np.divmod(ranked, c)
    model.slots = slots = np.where(turn % 2, c - 1 - place, place) * c + turn
    model.begin(frequency)
    flat, passes = model.flat, settings.passes(int(frequency.sum()))
    rounds = max(settings.rounds, passes)
    spelled = spark.sparkContext.broadcast(ids)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((flat, slots))
        span, rate = (turn * passes / rounds, (turn + 1) * passes / rounds), settings.rate * (1 - turn / rounds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, span=span, rate=rate) -> Iterator[pa.RecordBatch]:
            flat, slots = sent.value
            model = Attention(settings, flat.copy(), slots)
            for batch in batches:
                for marks, *block in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    marks = np.frombuffer(marks, np.uint8)
                    at = _place(len(marks))
                    for part in Block(*block, spelled.value).parts(np.flatnonzero(((marks & 1) == 0) & (np.floor(span[1] - at) > np.floor(span[0] - at)))):
                        model.train(*windows_of(*part[1:], settings.window, settings.stride), rate)
            if model.trained:
                yield _vector(np.append(model.flat.astype(float) * model.trained, model.trained))

        total = _total(whole.select("marks", "lengths", "codes", "ranks", "sizes").mapInArrow(run, "task long, v binary"), tasks)
        sent.unpersist()
        if total is not None:
            flat = (total[:-1] / total[-1]).astype(np.float32)
    spelled.unpersist()
    return {"ids": ids, "parameters": flat, "slots": slots, "tokens": int(frequency.sum())}


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, held, text).

    Every row is scored, and its text whole; a null text counts as empty and is its end alone, a null
    doc_id stays null. Without training texts all words are unknown, N is 0 and the model stays as it
    begins. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("held", F.lit(False)).alias("held"), F.col("text").cast("string"))
    ends, size = plain.agg(F.sum((~F.col("held")).cast("long")), F.sum(F.octet_length("text"))).first()
    ends, buckets = ends or 0, max(8, -(-(size or 0) // (8 * settings.block_bytes)))
    made = blocks(plain, buckets, path, settings)
    counts = word_counts(made)
    total, distinct = counts.agg(F.sum("total"), F.sum("distinct")).first()
    tokens, kinds = (total or 0) + ends, (distinct or 0) + (ends > 0)
    below = tokens + 0.5 * (kinds + 1)
    held = docs.sparkSession.sparkContext.broadcast(fit(made, path, settings))

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        r, model = block.iloc[0], Attention(settings, held.value["parameters"], held.value["slots"])
        texts = Block(r["lengths"], r["codes"], r["ranks"], r["sizes"], held.value["ids"])
        # the counts of the block's words, in the order of their codes: the block's hash order is found again from its buckets
        c = np.zeros(len(texts.each), np.int64)
        c[0] = ends
        order, bounds = _buckets_of(_unpack(r["hashes"], np.uint64), buckets)
        for k, packed in zip(found["bucket"], found["counts"]):
            c[1 + order[bounds[k] : bounds[k + 1]]] = np.frombuffer(packed, "<i8")
        base, known, n, marks = np.log10((c + 0.5) / below), (c > 0).astype(np.int64), texts.lengths, np.frombuffer(r["marks"], np.uint8)
        value = np.zeros(len(n))
        for part, ids, each in texts.parts(np.arange(len(n))):
            windows, wanted = windows_of(ids, each, settings.window, settings.stride)
            logs = model.score(windows, wanted).astype(np.float64).sum(1)
            count = -(-each // settings.stride)
            value[part] = np.add.reduceat(logs, np.cumsum(count) - count) / np.log(10)
        starts, ids = texts.ends - n, np.frombuffer(r["ids"], "<i8")
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64") if not (marks & 2).any() else pd.arrays.IntegerArray(ids.copy(), (marks & 2) > 0), "held_out": (marks & 1) > 0, "n_tokens": n, "n_known": np.add.reduceat(known[texts.codes], starts),
            "train_tokens": np.full(len(n), tokens), "base_score": np.add.reduceat(base[texts.codes], starts), "score": value,
        })

    texts = made.where("kind = 0").select("block", "ids", "marks", "lengths", "codes", "ranks", "sizes", "hashes")
    both = texts.groupBy("block").cogroup(counts.select("block", "bucket", "counts").groupBy("block"))
    return both.applyInPandas(run, RESULT)


def op1_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base log10 probabilities of every document; those with crc32(doc_id) mod 5 = 1 are held out of training."""
    return score(table(spark, sf_dir, "documents").select("doc_id", held_out(1).alias("held"), "text"))
