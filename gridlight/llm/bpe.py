"""Byte-level BPE encoding and decoding over Arrow batches (operator 10), by the tokenizers library.

A text is cut before those spaces that certainly begin a match of the splitting pattern: the ones
followed by other than white space (of a run of white space the pattern leaves the last space to what
follows), and between plain letters, punctuation and line ends. Every part is then independent, so each
worker keeps the ids of parts it has met. Ids travel as packed little-endian integers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from gridlight.llm.common import one_thread

#: Parts of texts that a worker remembers before it starts anew.
CACHE_PIECES = 600_000
_RISKY, _CUT = re.compile(r" \s"), re.compile(r" (?=\S)")
#: Classes of bytes: letters up to U+024F, ASCII punctuation but the apostrophe, line ends and spaces; between them the
#: splitting pattern always cuts. All other bytes are of class 0.
LETTER, MARK, LINE, GAP = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = LETTER
_CLASS[[b for low, high in ("!&", "(/", ":@", "[`", "{~") for b in range(ord(low), ord(high) + 1)]] = MARK
_CLASS[ord("\n")], _CLASS[ord(" ")] = LINE, GAP


def parts_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """(parts of all texts, one after another, number of each text's): texts without white space after a space, cut where the pattern cuts anyway.

    A part begins at a space, or where the class of bytes changes. What lies between spaces stays whole
    if it has a byte of class 0 or an empty line.
    """
    lines = pa.array(texts, pa.string())
    sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    kind = _CLASS.take(data)
    lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))  # of characters of two bytes: U+00C0 to U+027F
    first, second = data[lead], data[lead + 1]
    letter = ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F))
    kind[lead[~letter]] = 0
    kind[lead[letter] + 1] = LETTER
    piece = data == 0x20  # where a piece begins: at a space or with a text
    piece[(ends - sizes)[sizes > 0]] = True
    line, inside = kind == LINE, np.append(~piece[1:], False)
    odd = kind == 0
    odd[:-1] |= line[:-1] & line[1:] & inside[:-1]
    begins = np.empty(len(data), bool)
    begins[0], begins[1:] = True, (kind[1:] != kind[:-1]) & (kind[:-1] != GAP)
    begins |= piece
    starts = np.flatnonzero(begins)
    opens, pieces = piece[starts], np.flatnonzero(piece)
    whole = np.zeros(len(pieces), bool)
    whole[np.searchsorted(pieces, np.flatnonzero(odd), side="right") - 1] = True
    starts = starts[opens | ~whole[np.cumsum(opens) - 1]]
    bounds = np.append(starts, len(data)).astype(np.int32)
    cut = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return cut, np.diff(np.searchsorted(starts, np.append(0, ends)))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> str:
    """The JSON of a tokenizers-library tokenizer that encodes as the ranks do.

    A merge is any pair of tokens that together is a token, in the order of the merged token's rank.
    A match of the pattern that is a token itself is taken whole.
    """
    show = byte_characters()
    name = {token: "".join(show[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t.to_str()


class Encoder:
    """Encodes texts with one tokenizer; one per Python worker and tokenizer."""

    _made: dict[str, Encoder] = {}

    def __init__(self, spec: str):
        one_thread()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token begins with a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith(byte_characters()[32])]] = True
        self.known: dict[str, bytes] = {}  # the packed ids of parts, each with the space that it begins with

    @classmethod
    def of(cls, spec: str) -> Encoder:
        key = hashlib.sha1(spec.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def whole(self, text: str) -> bytes:
        """The packed ids of a text, encoded in one call."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _join(self, parts: list[str]) -> None:
        """Encodes parts that begin with a space, a hundred in a line, in one call and deals the ids out.

        No other token than a part's first begins with a space; where a part holds more spaces, offsets tell.
        """
        lines = ["".join(parts[at : at + 100]) for at in range(0, len(parts), 100)]
        ids = np.array([i for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], self.dtype)
        cut = np.flatnonzero(self.begins[ids])
        if len(cut) != len(parts):
            found = self.tokenizer.encode("".join(lines), add_special_tokens=False)
            ids, at = np.array(found.ids, self.dtype), np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            cut = np.searchsorted(at, np.cumsum([0, *(len(p) for p in parts[:-1])]))
        packed, ends = ids.tobytes(), (np.append(cut, len(ids)) * self.dtype.itemsize).tolist()
        self.known.update((p, packed[a:b]) for p, a, b in zip(parts, ends, ends[1:]))

    def _learn(self, missing: list[str]) -> None:
        """Remembers the packed ids of new parts."""
        spaced = [p for p in missing if p[:1] == " " and p != " "]
        if spaced:
            self._join(spaced)
        if rest := [p for p in missing if p[:1] != " " or p == " "]:  # what follows another part, begins a text, or is a space that ends it
            self.known.update((t, np.array(x.ids, self.dtype).tobytes()) for t, x in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)))

    def _few(self, texts: list[str]) -> list[bytes]:
        """The packed ids of some texts: their bytes are cut in one go, the distinct parts numbered by Arrow, and their ids laid out by number."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        risky = [bool(_RISKY.search(t)) for t in texts]
        cut, counts = parts_of([t for t, r in zip(texts, risky) if not r])
        slow = [_CUT.split(t) for t, r in zip(texts, risky) if r]
        cut = pa.concat_arrays([cut, pa.array([p if k == 0 else " " + p for x in slow for k, p in enumerate(x)], pa.string())])
        counts = np.append(counts, np.array([*map(len, slow)], np.int64))
        coded = cut.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [*filterfalse(self.known.__contains__, distinct)]:
            self._learn(new)
        packed = [*map(self.known.__getitem__, distinct)]
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // np.int32(self.dtype.itemsize)
        pool, begin = np.frombuffer(b"".join(packed), self.dtype), np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes.take(codes)
        ends = np.append(np.int32(0), np.cumsum(each, dtype=np.int32))
        at = np.repeat(begin.take(codes) - ends[:-1], each)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = pool.take(at)
        bounds = ends[np.append(0, np.cumsum(counts))].tolist()
        found = (ids[low:high].tobytes() for low, high in zip(bounds, bounds[1:]))
        order = sorted(range(len(texts)), key=risky.__getitem__)  # plain ones first, as they were cut
        out = [b""] * len(texts)
        for k, x in zip(order, found):
            out[k] = x
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text; some five million characters are cut at once."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= 5_000_000:
                yield from self._few(part)
                part, size = [], 0
        if part:
            yield from self._few(part)

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return self._few([text])[0]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character span of every token; tokens that split a character share its span."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets


def token_bytes(spec: str) -> list[bytes]:
    """id -> bytes, by the reversed byte table."""
    back = {c: bytes([b]) for b, c in enumerate(byte_characters())}
    vocab = json.loads(spec)["model"]["vocab"]
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = b"".join(back.get(c, c.encode()) for c in token)
    return table


def decode_tokens(ids: list[int], table: list[bytes]) -> list[str]:
    """The text of every token; a character that is split over tokens stands with the token that completes it."""
    import codecs

    step = codecs.getincrementaldecoder("utf-8")("replace")
    out = [step.decode(table[i]) for i in ids]
    if out:
        out[-1] += step.decode(b"", True)
    return out


def encode(docs: DataFrame, spec: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``out``: the packed ids of the whole text; a null text counts as empty.

    Other columns, also one named ``out`` or ``token_width`` (it is replaced), pass through.
    """
    plain = docs.drop(out, "token_width")
    held = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: a few MB whatever the input
    schema = plain.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(held.value)
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            packed = pa.array([*encoder.encode_all([t or "" for t in texts])], pa.binary())
            width = pa.array(np.full(len(texts), encoder.dtype.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, width], names=[*names, out, "token_width"])

    added = "".join(f", `{n}` {t}" for n, t in ((out, "binary"), ("token_width", "int")))
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + added
    return plain.mapInArrow(run, full)


def decode(coded: DataFrame, spec: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a binary column ``out``: the bytes that the packed ids stand for; null ids give null."""
    plain = coded.drop(out)
    held = coded.sparkSession.sparkContext.broadcast(spec)
    names = plain.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder.of(held.value), token_bytes(held.value)
        for batch in batches:
            packed = batch.column(names.index(ids)).to_pylist()
            back = [None if p is None else b"".join(map(table.__getitem__, encoder.ids(p).tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*names, out])

    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{out}` binary"
    return plain.mapInArrow(run, full)


def round_trip(docs: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """Encodes and decodes each text of ``docs`` and gives (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row per row of ``docs``, whatever its doc_id (null and repeated ids too). A null text counts as
    empty: no tokens, and the digests of nothing. Ids are decoded from the packed ids, not from the text.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder.of(held.value), token_bytes(held.value)
        digits = [str(i) for i in range(len(table))]
        for batch in batches:
            n, sha, back = [], [], []
            for packed in encoder.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                ids = encoder.ids(packed).tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_spec(path: str | None = None) -> str:
    """The tokenizer of a rank file; by default the 50k byte-level vocabulary."""
    return tokenizer_of_ranks(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))


def file_spec(path: str | None = None) -> str:
    """The tokenizer of a JSON file; by default the 50k byte-level vocabulary."""
    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json")).to_str()


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for every document."""
    from gridlight.llm.common import table

    return round_trip(table(spark, sf_dir, "documents"), rank_spec())
