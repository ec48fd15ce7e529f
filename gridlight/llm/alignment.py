"""Cross-tokenizer alignment (operator 13) by a group dictionary.

A text is encoded by two tokenizers, and cut where tokens of both end at the same byte: each cut piece
is a group of A ids and B ids. A corpus has far fewer distinct groups than tokens, so groups are interned:
blocks of documents keep numbers of their own for their groups, the links of a group (its A and B tokens
that share bytes) are expanded once for the whole corpus and multiplied by the group's frequency, and what
follows from the corpus-wide counts is joined back to the blocks by the group.

Spaces cut both tokenizers: neither has a token that goes on over a space after another character. So a
text is taken apart before such spaces, and each worker remembers the groups of the pieces it has met.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlight.llm.bpe import file_spec, token_bytes
from gridlight.llm.common import LARGE_ROWS, give_back, one_thread, table, written

#: UTF-8 bytes of texts in a block, bytes that are cut at once, and pieces that a worker remembers before it starts anew.
BLOCK_BYTES, CUT_BYTES, CACHE_PIECES = 2_000_000, 1_000_000, 200_000
#: What stands for a space in the second tokenizer's pieces.
MARK = "▁"
_CUT = re.compile(r"(?<=[^ ]) ")


@dataclass(frozen=True)
class Pair:
    """The two tokenizers: the JSON of a byte-level BPE (A), and the bytes of a sentencepiece model that adds a space (B)."""

    spec: str
    model: bytes

    @classmethod
    def of(cls, spec_path: str | None = None, model_path: str | None = None) -> Pair:
        """The tokenizers of two files; by default the 50k byte-level vocabulary and the 32k piece model."""
        with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            return cls(file_spec(spec_path), f.read())


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """id -> bytes: the piece in UTF-8 with its marks as spaces, or the byte that it stands for."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]


def links_of(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """The (A id, B id) of every two tokens of a group that share bytes, by a walk along both."""
    out, i, j, left_a, left_b = [], 0, 0, size_a[0], size_b[0]
    while True:
        out.append((a[i], b[j]))
        step = min(left_a, left_b)
        left_a, left_b = left_a - step, left_b - step
        if not left_a:
            i += 1
            if i == len(a):
                return out
            left_a = size_a[i]
        if not left_b:
            j += 1
            left_b = size_b[j]


def pack_group(a: bytes, b: bytes) -> bytes:
    """The key of a group from its packed 32-bit ids: the number of A ids, the A ids, the B ids."""
    return (len(a) >> 2).to_bytes(4, "little") + a + b


def unpack_group(key: bytes) -> tuple[list[int], list[int]]:
    ids = np.frombuffer(key, "<u4").tolist()
    return ids[1 : 1 + ids[0]], ids[1 + ids[0] :]


class Aligner:
    """Cuts texts into numbered groups; one per Python worker and pair of tokenizers. Numbers hold until ``forget``."""

    _made: dict[str, Aligner] = {}

    def __init__(self, pair: Pair):
        one_thread()
        self.a = Tokenizer.from_str(pair.spec)
        self.a.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        self.bytes_a, self.bytes_b = token_bytes(pair.spec), piece_bytes(self.b)
        self.size_a, self.size_b = (np.array([*map(len, t)], np.int64) for t in (self.bytes_a, self.bytes_b))
        made, probe = json.loads(pair.spec), " x  ﬁ①Ａ y "
        plain_a = made.get("normalizer") is None and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and made["pre_tokenizer"].get("use_regex", True)
        plain_b = not any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        plain_b = plain_b and b"".join(self.bytes_b[i] for i in self.b.encode(probe[1:])) == probe.encode()
        #: Whether spaces cut both tokenizers; else a text is one piece.
        self.cuts = bool(plain_a and plain_b)
        self.forget()

    @classmethod
    def of(cls, pair: Pair) -> Aligner:
        key = hashlib.sha1(pair.spec.encode() + pair.model).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(pair)
        return cls._made[key]

    def forget(self) -> None:
        self.pieces: dict[str, int] = {}  # a piece without the first of its spaces -> its number
        #: Of each piece: where its groups begin in ``flat``, how many they are, its tokens by A and by B (-1 where ids don't give back the text).
        self.known = np.zeros((0, 4), np.int64)
        self.flat = np.zeros(0, np.int32)
        self.groups: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.names: list[str] = []
        give_back()

    def _numbers(self, ids_a: np.ndarray, ids_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> np.ndarray:
        """The numbers of groups that end at these tokens, new ones given. Groups are sifted by a hash, and all of one hash are compared."""
        sides, mix = [], np.zeros(len(stop_a), np.uint64)
        for ids, stop, seed in ((ids_a, stop_a, 0x9E3779B97F4A7C15), (ids_b, stop_b, 0xC2B2AE3D27D4EB4F)):
            start = np.concatenate([[0], stop[:-1]])
            size = stop - start
            place = np.arange(len(ids)) - np.repeat(start, size)
            h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(seed) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            mix = (mix ^ np.add.reduceat(h ^ h >> np.uint64(32), start)) * np.uint64(seed)
            sides.append((ids, start, size))
        _, first, which = np.unique(mix, return_index=True, return_inverse=True)
        for ids, start, size in sides:  # every group has the ids of the first of its hash
            model = first[which]
            same = np.array_equal(size, size[model])
            shift = np.repeat(start[model] - start, size)
            if not same or not np.array_equal(ids, ids[np.arange(len(ids)) + shift]):
                first, which = np.arange(len(mix)), np.arange(len(mix))
                break
        (_, a0, na), (_, b0, nb) = sides
        packed_a, packed_b, own = ids_a.tobytes(), ids_b.tobytes(), []
        for a, n, b, m in zip(*((x[first] * 4).tolist() for x in (a0, na, b0, nb))):
            key = pack_group(packed_a[a : a + n], packed_b[b : b + m])
            if key not in self.groups:
                self.groups[key] = len(self.keys)
                self.keys.append(key)
                self.names.append("|".join(",".join(map(str, ids)) for ids in unpack_group(key)))
            own.append(self.groups[key])
        return np.array(own, np.int32)[which]

    def _keep(self, pieces: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Numbers pieces whose ids, laid end to end, give back their bytes: common ends are found for all in one go."""
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        numbers = self._numbers(ids_a, ids_b, *(np.searchsorted(e, common) + 1 for e in (end_a, end_b)))
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy() + 1)])
        counts = [np.diff(np.searchsorted(e, bounds, side="right")) for e in (common, end_a, end_b)]
        self._add(pieces, numbers, *counts)

    def _add(self, pieces: list[str], numbers: np.ndarray, count: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        self.pieces.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        begin = len(self.flat) + np.cumsum(count) - count
        self.known = np.concatenate([self.known, np.stack([begin, count, n_a, n_b], 1)])
        self.flat = np.concatenate([self.flat, numbers])

    def _learn(self, new: list[str]) -> None:
        """Numbers new pieces. Most are encoded as lines of a hundred; those with more spaces, and lines that ids don't give back, one by one."""
        single = [p for p in new if not p or p[0] == " " or not self.cuts]
        several = [p for p in new if p and p[0] != " "] if self.cuts else []
        lines = [several[k : k + 100] for k in range(0, len(several), 100)]
        said = [" " + " ".join(line) for line in lines]
        found_a = [x.ids for x in self.a.encode_batch_fast(said, add_special_tokens=False)] if said else []
        found_b = self.b.encode([x[1:] for x in said], num_threads=1) if said else []
        right = [b"".join(map(self.bytes_a.__getitem__, a)) == x.encode() == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, x in zip(found_a, found_b, said)]
        kept = [k for k, r in enumerate(right) if r]
        if kept:
            ids = [np.array([*itertools.chain.from_iterable(x[k] for k in kept)], "<u4") for x in (found_a, found_b)]
            self._keep([p for k in kept for p in lines[k]], *ids)
        alone, wrong = [], []
        for p in itertools.chain(single, *(lines[k] for k, r in enumerate(right) if not r)):
            a, whole = self.a.encode(" " + p, add_special_tokens=False).ids, (" " + p).encode()
            # a lone space is no text to the second tokenizer; where one ends a text it is a piece of its own
            b = self.b.encode(p) if p else [self.b.piece_to_id(MARK)]
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
                alone.append((p, a, b))
            else:
                wrong.append(p)
        if alone:
            self._keep([x[0] for x in alone], *(np.array([*itertools.chain.from_iterable(x[k] for x in alone)], "<u4") for k in (1, 2)))
        self._add(wrong, np.zeros(0, np.int32), np.zeros(len(wrong), int), *[np.full(len(wrong), -1)] * 2)

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """The pieces of texts that aren't empty, each without the first of its spaces, as they come."""
        if not self.cuts:
            return pa.array([[t] for t in texts], pa.list_(pa.string()))
        if not any(t[0] == " " or "  " in t for t in texts):
            return pc.split_pattern(pa.array(texts, pa.string()), " ")
        lists = [_CUT.split(" " + t) if t[0] == " " or "  " in t else t.split(" ") for t in texts]
        return pa.array([[x[0][1:], *x[1:]] if t[0] == " " or "  " in t else x for t, x in zip(texts, lists)], pa.list_(pa.string()))

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(numbers of the groups of all texts, groups of each text, (texts, 2) tokens of each by A and B, the digest of each text's groups).

        Empty texts and those that ids don't give back have no groups and no tokens.
        """
        full = [k for k, t in enumerate(texts) if t]
        counts, tokens, digests = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.int64), [""] * len(texts)
        if not full:
            return np.zeros(0, np.int32), counts, tokens, digests
        cut = self._cut([texts[k] for k in full])
        coded = cut.flatten().dictionary_encode()
        at, distinct, bounds = coded.indices.to_numpy(), coded.dictionary.to_pylist(), cut.offsets.to_numpy()
        if new := [*filterfalse(self.pieces.__contains__, distinct)]:
            self._learn(new)
        own = self.known[np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))]
        each = own[at, 2:]
        right = np.minimum.reduceat(each[:, 0], bounds[:-1]) >= 0
        sums = np.add.reduceat(each, bounds[:-1])
        at = at[np.repeat(right, np.diff(bounds))]
        begin, n = own[at, 0], own[at, 1]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))]
        last = np.cumsum(np.where(right, np.diff(bounds), 0))
        total = np.concatenate([[0], ends])[np.concatenate([[0], last])]
        names = self.names.__getitem__
        for k, r, low, high, s in zip(full, right.tolist(), total[:-1].tolist(), total[1:].tolist(), sums):
            if r:
                counts[k], tokens[k] = high - low, s
                digests[k] = hashlib.sha256(";".join(map(names, flat[low:high].tolist())).encode()).hexdigest()
        return flat, counts, tokens, digests


_BLOCK = "block string, ids binary, known binary, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, codes binary, groups array<binary>, n array<long>, docs array<long>"


def blocks_of(docs: DataFrame, pair: Pair) -> DataFrame:
    """``docs`` (doc_id, text) in blocks of up to 2 MB of texts, or of one longer text; written once.

    A block has its documents' ids packed in ``ids`` (and in ``known`` whether they are not null), and the
    arrays n_a, n_b, n_groups and digest, the groups of all of
    them, one after another, as packed 16-bit numbers in ``codes`` (32-bit where a block has more groups), and what the numbers stand for in the
    arrays groups, n (occurrences in the block) and docs (documents of it). A block is named by its
    partition and its number there.
    """
    held = docs.sparkSession.sparkContext.broadcast(pair)  # two vocabulary files: a few MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, partition = Aligner.of(held.value), TaskContext.get().partitionId()
        ids, parts, made, size = [], [], 0, 0

        def block() -> pa.RecordBatch:
            flat, counts, tokens, digests = (np.concatenate(x) for x in zip(*parts))
            seen = np.bincount(flat, minlength=len(aligner.keys))
            present = np.flatnonzero(seen)
            number = np.zeros(len(seen), np.int64)
            number[present] = np.arange(len(present))
            codes = number[flat]
            once = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(present)) + codes) % max(1, len(present))
            packed = np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids]).tobytes()
            columns = [*packed, tokens[:, 0], tokens[:, 1], counts, digests.tolist(), codes.astype("<u2" if len(present) <= 1 << 16 else "<u4").tobytes(), [aligner.keys[k] for k in present.tolist()], seen[present], np.bincount(once, minlength=len(present))[: len(present)]]
            row = [pa.array([f"{partition}:{made}"]), *(pa.array([c], t) for c, t in zip(columns, [pa.binary()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary())] + [pa.list_(pa.int64())] * 2))]
            return pa.RecordBatch.from_arrays(row, names=[c.split(" ")[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            sizes, at = pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), 0
            while at < len(sizes):
                end, some = at, 0
                while end < len(sizes) and some < CUT_BYTES:
                    some += sizes[end]
                    end += 1
                if not parts and len(aligner.pieces) > CACHE_PIECES:
                    aligner.forget()
                part = batch.slice(at, end - at)  # texts become strings a few at a time
                parts.append(aligner.align([t or "" for t in part.column(1).to_pylist()]))
                ids += part.column(0).to_pylist()
                at, size = end, size + some
                if size >= BLOCK_BYTES or len(ids) >= 50_000:
                    yield block()
                    ids, parts, made, size = [], [], made + 1, 0
        if ids:
            yield block()
        # the worker serves later stages too: what it knows of pieces goes
        parts = batch = part = None
        aligner.forget()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCK), "aligned", **LARGE_ROWS)


def interned(blocks: DataFrame) -> DataFrame:
    """(block, code, group, n, docs): the dictionary of every block."""
    entries = F.posexplode(F.arrays_zip("groups", "n", "docs")).alias("code", "e")
    return blocks.select("block", entries).select("block", "code", F.col("e.groups").alias("group"), F.col("e.n").alias("n"), F.col("e.docs").alias("docs"))


def expanded(entries: DataFrame, pair: Pair, weight: str = "n") -> DataFrame:
    """(group, a, b, times, weight): the links of every distinct group, expanded once; written once.

    ``times`` is how often a group has the link. ``weight`` sums the groups' column of that name over
    the blocks: "n" for occurrences, "docs" for documents.
    """
    sizes = [*map(len, token_bytes(pair.spec))], [*map(len, piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=pair.model)))]
    held = entries.sparkSession.sparkContext.broadcast(sizes)  # of the tokens: no task needs the tokenizers for it
    distinct = entries.groupBy("group").agg(F.sum(weight).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = held.value
        for batch in batches:
            rows: list[tuple] = []
            for key, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = unpack_group(key)
                found: dict[tuple[int, int], int] = {}
                for link in links_of(a, b, [size_a[i] for i in a], [size_b[i] for i in b]):
                    found[link] = found.get(link, 0) + 1
                rows += [(key, x, y, times, weight) for (x, y), times in found.items()]
            columns = [*zip(*rows)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["group", "a", "b", "times", "weight"])

    return written(distinct.mapInArrow(run, "group binary, a int, b int, times long, weight long"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each id pair linked, and whether no pair of its B id has more; written once."""
    pairs = written(links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("weight")).alias("count")), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, pair: Pair | None = None, weight: str = "n") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of ``docs`` (doc_id, text): what each document's links are worth, and the counted id pairs.

    ``documents`` has one row per row of ``docs``, null and repeated doc_ids too: doc_id, n_a and n_b
    (tokens), n_groups, n_links, n_best (links whose pair has its B id's highest count), count_sum (over its
    links) and groups_sha256. ``pairs`` is as ``pair_counts`` gives it. Null and empty texts and those that
    either tokenizer's ids don't give back (the second writes U+2581 as a space) have no tokens: zeros
    and an empty digest. Other columns of ``docs`` are not read. Group dictionaries are pre-aggregated by
    block, so a group that is in every text is one row a block.
    """
    pair = pair or Pair.of()
    blocks = blocks_of(docs, pair)
    entries = interned(blocks)
    links = expanded(entries, pair, weight)
    pairs = pair_counts(links)
    worth = links.join(pairs, ["a", "b"]).groupBy("group").agg(F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("count")).alias("counted"))
    back = entries.select("block", "code", "group").join(worth, "group").select(F.col("block").alias("of"), "code", "links", "best", "counted")

    def per_document(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples(index=False):
            values = np.zeros((len(own), 3), np.int64)
            values[own["code"].to_numpy()] = own[["links", "best", "counted"]].to_numpy()
            counts = np.asarray(row.n_groups, np.int64)
            codes = np.frombuffer(row.codes, f"<u{len(row.codes) // max(1, int(counts.sum())) or 2}")
            sums, full = np.zeros((len(counts), 3), np.int64), counts > 0
            if full.any():
                starts = (np.cumsum(counts) - counts)[full]
                for k in range(3):
                    sums[full, k] = np.add.reduceat(values[codes, k], starts)
            ids = pd.arrays.IntegerArray(np.frombuffer(row.ids, "<i8").astype(np.int64), ~np.frombuffer(row.known, bool))
            out.append(pd.DataFrame({"doc_id": ids, "n_a": row.n_a, "n_b": row.n_b, "n_groups": counts, "n_links": sums[:, 0], "n_best": sums[:, 1], "count_sum": sums[:, 2], "groups_sha256": row.digest}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    dealt = blocks.select("block", "ids", "known", "n_a", "n_b", "n_groups", "digest", "codes").groupBy("block").cogroup(back.groupBy("of"))
    found = dealt.applyInPandas(per_document, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found, pairs


def op13_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and what they count for, for every document."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
