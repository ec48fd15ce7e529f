"""Token-ID files (operator 6): Arrow files of fixed-size-list batches, written in document order and read back without copies.

A file holds the tokens of consecutive documents, end tokens included, as rows of ``length`` ids and a
mask; only a file's last row is padded. Any row or token is found by arithmetic, on a memory map
without reading the rest. Beside it, ``.docs`` has every document's place in the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm.bpe import Encoder, file_spec
from gridlight.llm.common import shared_dir, table

#: Tokens of one row, and rows of one record batch.
LENGTH, BATCH_ROWS = 1024, 1024


class TokenFile:
    """Writes one file and its index; the names are final once closed."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.dtype, self.length = f"{root}/{name}.arrow", dtype, length
        kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = 0

    def add(self, packed: bytes) -> None:
        self.waiting.append(packed)
        self.bytes += len(packed)
        if self.bytes >= (most := BATCH_ROWS * self.length * self.dtype.itemsize):
            data = b"".join(self.waiting)
            for at in range(0, len(data) - most + 1, most):
                self._batch(np.frombuffer(data, self.dtype, BATCH_ROWS * self.length, at), None)
            rest = data[len(data) // most * most :]
            self.waiting, self.bytes = [rest], len(rest)

    def _batch(self, ids: np.ndarray, used: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if used is not None:
            mask[used:] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self, docs: pa.Table) -> None:
        rest = np.frombuffer(b"".join(self.waiting), self.dtype)
        if len(rest):
            full = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            full[: len(rest)] = rest
            self._batch(full, len(rest))
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(f"{self.path}.docs") as sink, pa.ipc.new_file(sink, docs.schema) as index:
            index.write_table(docs)


def write(docs: DataFrame, spec: str, folder: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order and returns the manifest.

    Documents are dealt out by ranges of doc_id, so that each task writes one file of consecutive
    documents. Equal ids are ordered by a hash of their text, so that they need not share a task, null
    ids come first, and a null text is only the end token. The manifest (part, path, n_docs, n_tokens) is what counts: a task that was lost
    leaves a file that no row of it names.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(held.value)
        end, part = np.array([end_id], encoder.dtype).tobytes(), TaskContext.get().partitionId()
        out, ids, lengths = None, [], []
        for batch in batches:
            if batch.num_rows and out is None:
                out = TokenFile(folder, f"{part:06d}-{uuid.uuid4().hex}", encoder.dtype, length)
            ids.append(batch.column(0))
            for ids_of in encoder.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                out.add(packed := ids_of + end)
                lengths.append(len(packed) // encoder.dtype.itemsize)
        if out is not None:
            out.close(pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())}))
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [out.path], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # the bounds of ranges are sampled on the driver: numbers, not texts
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    manifest = ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_rows(path: str, folder: str, rows: list[int]) -> list[np.ndarray]:
    """The given rows of a token file without their padding; the file is mapped, not read, where the store is a disk."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    with pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as source:
        reader, found = pa.ipc.open_file(source), []
        for row in rows:
            batch = reader.get_batch(row // BATCH_ROWS)
            ids, mask = (batch.column(c)[row % BATCH_ROWS].values for c in (0, 1))
            found.append(ids.to_numpy(zero_copy_only=True)[: mask.true_count])
        return found


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32), read from them in the order of the manifest.

    Only the number of tokens of each file comes to the driver, which adds them up to the files'
    first positions. The batches of a file are read one after the other, each without a copy.
    """
    spark = manifest.sparkSession
    files = sorted(map(tuple, manifest.select("part", "path", "n_tokens").collect()))
    starts = np.cumsum([0, *(f[2] for f in files)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for path, start in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            with fs.open_input_file(f"{path}.docs") as source:
                docs = pa.ipc.open_file(source).read_all()
            lengths = docs["n_tokens"].to_numpy()
            begins = start + np.cumsum(lengths) - lengths
            crcs = np.zeros(len(lengths), np.int64)
            with pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path) as source:
                reader = pa.ipc.open_file(source)
                doc, left, crc = 0, int(lengths[0]), 0
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    ids = batch.column(0).values.to_numpy(zero_copy_only=True)[: batch.column(1).values.true_count]
                    at = 0
                    while at < len(ids):
                        take = min(left, len(ids) - at)
                        crc = zlib.crc32(ids[at : at + take].astype("<u4").tobytes(), crc)
                        at, left = at + take, left - take
                        if not left:
                            crcs[doc], doc, crc = crc, doc + 1, 0
                            left = int(lengths[doc]) if doc < len(lengths) else 0
            for rows in pa.table({"doc_id": docs["doc_id"], "start": begins, "n_tokens": lengths, "ids_crc32": crcs}).to_batches(max_chunksize=50_000):
                yield rows

    places = spark.createDataFrame([(path, start) for (_, path, _), start in zip(files, starts)], "path string, start long").repartition(max(1, len(files)))
    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files written for the whole table."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), file_spec(), folder), folder)
