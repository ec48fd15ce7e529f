"""Benchmark decontamination (operator 5): a distributed positional inverted index.

The index is dealt out by blocks of documents. A row of it is one term of one block: the documents and
word positions where the term stands, packed. A search takes each window of a test item from its
rarest term on and intersects the offset-adjusted position lists, block by block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import table, written

#: Words of a window, UTF-8 bytes of documents in a block, and bytes of test texts that are searched at once.
WINDOW, BLOCK_BYTES, QUERY_BYTES = 10, 4_000_000, 8_000_000
#: Bytes that belong to words: digits, letters and all of a character beyond ASCII; A-Z as a-z, others as a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Candidate places that are looked at at once, at least one window's; these bound a search's memory.
CANDIDATES = 2_000_000
#: The term under which a block keeps its documents themselves.
DOCUMENTS = b""


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text; none for a null."""
    return (text or b"").translate(FOLD).split()


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """Postings (block, term, docs, positions) of ``docs`` (doc_id, text), packed as little-endian integers; written once.

    ``docs`` holds the posting's document number in its block and ``positions`` its word positions,
    both ascending. Each block has one more row with the term b"": as ``docs`` its doc_ids, their row
    numbers, and whether the doc_ids are not null, as ``positions`` the numbers of words; it has all
    documents, also those without words. Row numbers are given here. A block is named by its
    partition and its number there, so equal blocks are told apart. With a
    ``vocabulary`` only its terms are stored; it is broadcast, so its size has to be bounded.
    A block is up to 4 MB of texts, or one longer text, whatever the size of the table.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "block string, term binary, docs binary, positions binary"

    def rows(block: str, ids: list[int | None], numbers: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes: dict[bytes, int] = {} if held.value is None else {w: k for k, w in enumerate(held.value)}
        if held.value is None:
            for t in texts:
                for w in t:
                    codes.setdefault(w, len(codes))
        get = codes.get
        flat = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(lengths.sum()))
        at = np.flatnonzero(flat >= 0)
        order = np.argsort(flat[at], kind="stable")
        at, starts = at[order], np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[at]
        pos = (at - starts[doc]).astype("<i4")
        present, begin = np.unique(flat[at], return_index=True)
        ends, names = [*begin[1:], len(at)], list(codes)
        out = [(DOCUMENTS, np.array([*(i or 0 for i in ids), *numbers, *(i is not None for i in ids)], "<i8").tobytes(), lengths.astype("<i4").tobytes())]
        out += [(names[c], doc[b:e].tobytes(), pos[b:e].tobytes()) for c, b, e in zip(present.tolist(), begin.tolist(), ends)]
        terms, d, p = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(out)), *(pa.array(x, pa.binary()) for x in (terms, d, p))], names=["block", "term", "docs", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, texts, size, made, partition = [], [], [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, text, number in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                numbers.append(number)
                texts.append(words(text))
                size += len(text or b"")
                if size >= BLOCK_BYTES or len(ids) >= 50_000:
                    yield rows(f"{partition}:{made}", ids, numbers, texts)
                    ids, numbers, texts, size, made = [], [], [], 0, made + 1
        if ids:
            yield rows(f"{partition}:{made}", ids, numbers, texts)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    return written(plain.mapInArrow(run, schema), "index")


def windows(items: list[tuple[str, bytes | None]], size: int = WINDOW) -> tuple[list[tuple[bytes, ...]], list[list[int]]]:
    """(distinct windows, the numbers of the items that have each): all runs of ``size`` words, or a shorter item whole."""
    found: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        w = words(text)
        for window in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            found.setdefault(window, []).append(k)
    return list(found), list(found.values())


class BlockIndex:
    """The postings of one block in memory; places are positions in the block's documents laid end to end."""

    def __init__(self, rows: pd.DataFrame):
        own = rows["term"].map(len) == 0
        ids, lengths = rows.loc[own, ["docs", "positions"]].iloc[0]
        values, self.rows, known = np.frombuffer(ids, "<i8").reshape(3, -1)
        self.ids, self.lengths = pd.arrays.IntegerArray(values.astype(np.int64), known == 0), np.frombuffer(lengths, "<i4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.packed = {t: (d, p) for t, d, p in rows.loc[~own, ["term", "docs", "positions"]].itertuples(index=False)}
        self.opened: dict[bytes, np.ndarray] = {}

    def places(self, term: bytes) -> np.ndarray:
        if term not in self.opened:
            d, p = self.packed[term]
            self.opened[term] = self.starts[np.frombuffer(d, "<i4")] + np.frombuffer(p, "<i4")
        return self.opened[term]

    def phrases(self, windows: list[tuple[bytes, ...]], slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, place) of all occurrences of ``windows``; with ``slack``, each word at most that many words off its place.

        All windows are searched at once. Candidates are the places of each window's rarest term here;
        each further term, from the rarer ones on, keeps those that its offset-adjusted list has, by a
        search in the block's postings laid end to end, term after term.
        """
        terms = {t: k for k, t in enumerate(self.packed)}
        found = [k for k, w in enumerate(windows) if all(map(terms.__contains__, w))]
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not found:
            return nothing
        lists = [self.places(t) for t in terms]
        sizes, span = np.array([len(x) for x in lists], np.int64), int(self.lengths.sum()) + 2 * (slack + 1) + max(map(len, windows))
        flat = np.concatenate(lists)
        postings = flat + np.repeat(np.arange(len(lists)) * span, sizes)  # ascending
        begins = np.cumsum(sizes) - sizes
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for length in sorted({len(windows[k]) for k in found}):
            own = np.array([k for k in found if len(windows[k]) == length], np.int64)
            words = np.array([[terms[t] for t in windows[k]] for k in own.tolist()], np.int64)
            order = np.argsort(sizes[words], axis=1, kind="stable")
            # windows are taken together while their rarest terms have few enough places
            candidates = np.cumsum(sizes[words[np.arange(len(own)), order[:, 0]]])
            low = 0
            while low < len(own):
                before = int(candidates[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(candidates, before + CANDIDATES, side="right")))
                rows, low = np.arange(low, high), high
                rarest = words[rows, order[rows, 0]]
                n = sizes[rarest]
                row = np.repeat(rows, n)
                at = flat[np.repeat(begins[rarest] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - order[row, 0]
                inside = at >= 0
                row, at = row[inside], at[inside]
                for rank in range(1, length):
                    if not len(at):
                        break
                    offset = order[row, rank]
                    key = words[row, offset] * span + at + offset
                    # with slack a place before the first or behind the last word is still one of the term's own
                    near = np.searchsorted(postings, np.maximum(key - slack, words[row, offset] * span))
                    kept = (near < len(postings)) & (postings[np.minimum(near, len(postings) - 1)] <= key + slack)
                    row, at = row[kept], at[kept]
                hits.append((own[row], at))
        number, at = (np.concatenate(x) for x in zip(*hits))
        doc = np.searchsorted(self.starts + self.lengths, at, side="right")
        inside = doc < len(self.starts)
        number, at, doc = number[inside], at[inside], doc[inside]
        size = np.array([len(w) for w in windows], np.int64)[number]
        inside = (at >= self.starts[doc]) & (at + size <= self.starts[doc] + self.lengths[doc])
        return number[inside], at[inside]

    def phrase(self, window: tuple[bytes, ...], slack: int = 0) -> np.ndarray:
        """The places of one window, ascending."""
        return np.sort(self.phrases([window], slack)[1])


def search(index: DataFrame, items: list[tuple[str, bytes | None]], size: int = WINDOW, slack: int = 0) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of every indexed document: the hit spans, and the items with a window in it.

    ``spans`` has begin and end of each run of hit words, packed as integers, ``items`` the sorted
    item_ids. Only the windows' own terms are needed in the index. Blocks are independent.
    """
    found, owners = windows(items, size)
    held = index.sparkSession.sparkContext.broadcast((found, owners, [i for i, _ in items]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = BlockIndex(rows)
        found, owners, names = held.value
        total = int(block.lengths.sum())
        number, at = block.phrases(found, slack)
        size = np.array([len(w) for w in found], np.int64)[number] if len(number) else number
        cover = np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + size, minlength=total + 1)[: total + 1]
        hits = [set() for _ in block.ids]
        doc = np.searchsorted(block.starts + block.lengths, at, side="right")
        for d, w in np.unique(np.stack([doc, number], 1), axis=0).tolist():
            hits[d].update(owners[w])
        hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(hit))
        # runs end at document borders
        begin, end = edge[::2], edge[1::2]
        spans = []
        for s, n in zip(block.starts.tolist(), block.lengths.tolist()):
            a, b = np.searchsorted(end, s, side="right"), np.searchsorted(begin, s + n)
            own = np.stack([np.maximum(begin[a:b], s) - s, np.minimum(end[a:b], s + n) - s], 1) if b > a else np.zeros((0, 2))
            spans.append(own.astype("<i4").tobytes())
        return pd.DataFrame({"row": block.rows, "doc_id": block.ids, "n_words": block.lengths, "spans": spans, "items": [sorted({names[k] for k in h}) for h in hits]})

    return index.groupBy("block").applyInPandas(run, "row long, doc_id long, n_words long, spans binary, items array<string>")


def item_slices(benchmark: DataFrame, most: int = QUERY_BYTES) -> Iterator[list[tuple[str, bytes | None]]]:
    """The test items in slices of at most about ``most`` bytes of text, so that each can be broadcast; nulls have no words."""
    plain = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    slices = -(-int(size) // most) or 1
    for k in range(slices):
        part = plain if slices == 1 else plain.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        yield sorted((r.item_id, bytes(r.text) if r.text is not None else None) for r in part.collect())


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items): what of each document is in windows of benchmark items.

    Benchmarks of up to 8 MB of text are searched at once, in an index of their own terms; larger ones
    slice by slice in one index of all terms, from which each slice takes the postings of its terms, and
    the spans and items of a document are joined by its row number. Null texts have no words; repeated
    item_ids count as one item, and items without an item_id are left out; documents whose doc_id is null or
    repeats give a row each.
    """
    slices = item_slices(benchmark)
    first, second = next(slices), next(slices, None)
    terms_of = lambda items: {w for _, t in items for w in words(t)}
    index = build_index(docs, frozenset(terms_of(first)) if second is None else None)  # written once, so a row has its number in each slice
    if second is None:
        return search(index, first, size).drop("row")
    parts = []
    for items in itertools.chain([first, second], slices):
        own = docs.sparkSession.createDataFrame([(bytearray(t),) for t in {DOCUMENTS} | terms_of(items)], "term binary")
        parts.append(search(index.join(F.broadcast(own), "term", "left_semi"), items, size))  # at most 8 MB of terms
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    grouped = both.groupBy("row", "doc_id", "n_words").agg(F.collect_list("spans").alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    joined = F.pandas_udf(lambda found: found.map(merge_spans), "binary", F.PandasUDFType.SCALAR)
    return grouped.select("doc_id", "n_words", joined("all").alias("spans"), "items")


def merge_spans(found: list[bytes]) -> bytes:
    """The union of packed span lists, as one."""
    out: list[list[int]] = []
    for b, e in sorted(map(tuple, np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in found]).tolist())) if len(found) else ():
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return np.array(out, "<i4").tobytes()


def span_words(spans: bytes) -> int:
    """Words covered by packed spans."""
    s = np.frombuffer(spans, "<i4").reshape(-1, 2)
    return int((s[:, 1] - s[:, 0]).sum())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    count = F.pandas_udf(lambda spans: spans.map(span_words).astype("int64"), "long", F.PandasUDFType.SCALAR)
    found = found.withColumn("n_hit", count("spans"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_distinct("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without a window of a benchmark item, with their columns.

    A row is judged by its own text, whatever its doc_id: rows whose doc_id is null or repeats stay or
    go one by one. Null and empty texts stay.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(f"_row{k}" for k in range(len(taken) + 1) if f"_row{k}" not in taken)
    # rows are numbered once and written: a number read again is the same one
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    hit = contamination(numbered.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where(F.size("items") > 0).select(F.col("doc_id").alias(name))
    return numbered.join(hit, name, "left_anti").select(*docs.columns)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op5_decontamination": f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS said FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: {{'k': k, 'said': array_to_string(w[k:k + size - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT doc_id, grams.size, x.k AS k, item FROM grams JOIN win ON win.size = grams.size AND win.said = x.said),
spot AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT doc_id, size, k FROM hit)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(spot.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(spot.n, 0) > 0 AS contaminated FROM d LEFT JOIN spot ON spot.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id""",
}
