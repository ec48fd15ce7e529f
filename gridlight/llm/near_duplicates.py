"""MinHash near-duplicates (operator 4) by min-max hashing.

Each hash function is evaluated once a shingle and gives two signature values, its minimum and its
maximum. Bands of the signature are candidate keys; every candidate pair is then decided on the whole
shingle sets. Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.common import components, never_sent, table, written


@dataclass(frozen=True)
class Settings:
    """Shingle words, the link threshold (100 * intersection >= percent * union), and the bands.

    21 bands of 6 values (3 hash functions each): a pair at 0.85 shares no band with a probability of
    about 5e-5, one at 0.3 shares one with 1.5 %.
    """

    words: int = 5
    percent: int = 85
    bands: int = 21
    functions: int = 3  # hash functions of a band
    pairs_up_to: int = 24  # sets of a bucket whose pairs are listed; larger buckets are compared in blocks
    block: int = 400  # sets of a block


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    KEPT = 400_000  # word hashes kept before starting anew

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: bytes | None) -> np.ndarray:
        """With fewer words than a shingle has, the whole sequence is one; no words give the empty set."""
        known, words = self.known, (text or b"").lower().split()
        if len(known) > self.KEPT:
            known.clear()
        for w in filterfalse(known.__contains__, {*words}):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def signature_bands(sets: list[np.ndarray], settings: Settings) -> np.ndarray:
    """(sets, bands) 64-bit keys: a mix of the minima and maxima of each band's hash functions. Sets must not be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    seeds = np.random.default_rng(4).integers(1, 1 << 63, size=(settings.bands * settings.functions, 2), dtype=np.uint64) | np.uint64(1)
    keys = np.zeros((len(sets), settings.bands), np.uint64)
    for f, (a, b) in enumerate(seeds):
        x = flat * a
        x ^= x >> np.uint64(29)
        x *= b
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        key = keys[:, f // settings.functions]
        for value in (low, high):
            key ^= value
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    return keys


def said() -> Column:
    """A hash of the text; with the doc_id it finds a text again, also where a doc_id has several."""
    return F.xxhash64(F.col("text").cast("string")).alias("said")


def shingle_sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, said, n_shingles, fingerprint, keys) of ``docs`` (doc_id, text): a hash of the text, the set's size, a 128-bit digest of it and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(settings.words)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):  # a few MB of texts at once
                end, size = at, 0
                while end < len(texts) and size < 2_000_000:
                    size += len(texts[end] or b"")
                    end += 1
                sets = [shingles.of(t) for t in texts[at:end]]
                full = [k for k, s in enumerate(sets) if len(s)]
                bands = np.zeros((len(sets), settings.bands), np.uint64)
                if full:
                    bands[full] = signature_bands([sets[k] for k in full], settings)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys = [b.tobytes() if len(s) else None for b, s in zip(bands, sets)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "said", "n_shingles", "fingerprint", "keys"])
                at = end

    return docs.select(F.col("doc_id").cast("long"), said(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, said long, n_shingles long, fingerprint binary, keys binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of ``pairs`` over 0..n-1."""
    up, kept = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        if (ra := root(a)) != (rb := root(b)):
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Index pairs (i, j), i in ``left`` and j in ``right``, whose sets are linked; with right None, the pairs i < j of ``left``.

    Intersections are products of 0/1 rows over the hashes that at least two sets have, a slice of
    hashes at a time, so memory is bounded by the block and not by the texts.
    """
    sets = left + (right or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return np.zeros((0, 2), np.int64)
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n, m = len(left), len(sets)
    both = np.zeros((n, n if right is None else m - n), np.float32)
    for low in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        dense = np.zeros((m, 4096), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        both += dense[:n] @ (dense[:n] if right is None else dense[n:]).T
    sizes = np.array([len(s) for s in sets], np.int64)
    union = sizes[:n, None] + (sizes[:n] if right is None else sizes[n:])[None] - both
    found = np.argwhere(100 * both.astype(np.int64) >= percent * union.astype(np.int64))
    return found[found[:, 0] < found[:, 1]] if right is None else found


def _sets_of(docs: DataFrame, settings: Settings) -> DataFrame:
    """(node, packed set) of ``docs`` (node, text, fingerprint), for texts of that fingerprint; rows that repeat a node's text give its set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(settings.words)
        for batch in batches:
            packed = [shingles.of(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            same = [xxhash.xxh3_128_digest(p) == f for p, f in zip(packed, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "packed"]).filter(pa.array(same, pa.bool_()))

    return docs.mapInArrow(run, "node long, packed binary").dropDuplicates(["node"])


def links(nodes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Edges (a, b) that connect all nodes linked by their sets, directly or through others.

    ``nodes`` (node, doc_id, said, fingerprint, keys) has one node for each distinct set, whose text is in ``docs`` (doc_id, text) under that doc_id and hash.
    Small buckets list their pairs, each decided once. Members of a larger bucket are dealt into
    blocks, and every two blocks are compared in one task, which keeps a spanning forest of the links
    it finds. Only candidate sets travel, and nothing is dropped.
    """
    positions = F.array(*[F.struct(F.lit(k).alias("band"), F.substring("keys", 8 * k + 1, 8).alias("key")) for k in range(settings.bands)])
    members = nodes.select("node", F.explode(positions).alias("at")).select("node", F.xxhash64("at.band", "at.key").alias("bucket"))
    counted = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # buckets with the same members (equal counts, ends and 128 bits of their hashes) are one
    several = counted.where("n > 1").groupBy("n", "first", "last", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    placed = written(never_sent(members).join(several, "bucket"), "members")  # 21 rows or more of each node

    small = placed.where(F.col("n") <= settings.pairs_up_to).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("m"))
    tails = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + F.lit(2), F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = written(small.select(F.explode(tails).alias("p")).select("p.a", "p.b").where("a < b").distinct(), "pairs")

    wanted = nodes.select("node", "doc_id", "said", "fingerprint").join(never_sent(placed.select("node").distinct()), "node", "left_semi")
    sets = written(_sets_of(docs.withColumn("said", said()).join(never_sent(wanted), ["doc_id", "said"]).select("node", "text", "fingerprint"), settings), "sets")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (map(lambda p: np.frombuffer(p, np.uint64), batch.column(c).to_pylist()) for c in (2, 3))
            hit = pa.array([_linked(p, q, settings.percent) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(hit)

    first = never_sent(pairs).join(sets.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    listed = never_sent(first).join(sets.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")

    # block numbers i <= j of a large bucket; a member goes to every pair that its block is in
    blocks = F.ceil(F.col("n") / F.lit(settings.block)).cast("int")
    large = placed.where(F.col("n") > settings.pairs_up_to).select("bucket", "node", blocks.alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    other = large.select("bucket", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = other.select("bucket", "node", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine")
    dealt = never_sent(dealt).join(sets, "node")  # a row for each block of the bucket

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        mine, i, j = rows["mine"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
        unpack = lambda r: [np.frombuffer(p, np.uint64) for p in r["packed"]]
        left, right = rows[mine == i], rows[mine == j]
        if i == j:
            ids, found = left["node"].to_numpy(), block_links(unpack(left), None, settings.percent)
        elif len(left) and len(right):
            ids, found = np.concatenate([left["node"], right["node"]]), block_links(unpack(left), unpack(right), settings.percent) + [0, len(left)]
        else:
            ids, found = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        kept = np.array(_forest(found, len(ids)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[kept[:, 0]], "b": ids[kept[:, 1]]})

    blocked = dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")
    return listed.unionByName(blocked)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text): one row per row with a doc_id.

    Null and empty texts and texts of white space have an empty set and are linked with nothing.
    Rows with a null doc_id are left out. Rows that repeat a doc_id count as other documents: each is
    linked by its own text, and the component_id is the smallest doc_id of what it reaches.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = written(shingle_sets(texts, settings), "shingles")
    same = made.where("n_shingles > 0").groupBy("fingerprint").agg(F.min_by(F.struct("doc_id", "said"), F.struct("doc_id", "said")).alias("from"), F.first("keys").alias("keys"))
    # a node is a set, numbered once and written; the smallest doc_id that has it stands beside
    same = written(same.select(F.monotonically_increasing_id().alias("node"), "from.doc_id", "from.said", "fingerprint", "keys"), "nodes")
    joined = components(links(same, texts, settings))
    placed = same.select("fingerprint", "node", "doc_id").join(never_sent(joined), "node", "left").select("fingerprint", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.select("fingerprint", "component").join(never_sent(least), "component").select("fingerprint", "component_id")
    linked = made.where("n_shingles > 0").join(never_sent(found), "fingerprint").select("doc_id", "n_shingles", "component_id")
    alone = made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and decision for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The stage's threshold; a pair at 0.8 shares none of its bands with a probability of about 5e-5.
STAGE = Settings(percent=80, bands=33)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group (the smallest doc_id) of similarity 0.8 or more, with its columns.

    Rows that repeat a doc_id stay if one of them does; rows without a doc_id stay.
    """
    gone = near_duplicates(docs, STAGE).groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select("doc_id")
    return docs.join(never_sent(gone), "doc_id", "left_anti").select(*docs.columns)


_COMPONENTS = """both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT {id} AS node, {id} AS seen FROM {table} UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)"""


def components_sql(table: str, key: str) -> str:
    """DuckDB (recursive): comp (node, component_id) of the edges e (a, b) over a table's ids."""
    return _COMPONENTS.format(table=table, id=key)


ORACLES = {
    "op4_min_max_hash": f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
{components_sql('documents', 'doc_id')}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
