"""Token-id files of independent zstandard frames with a trailing seek table.

One file holds a range of documents in ascending ``doc_id`` order::

    frame of document 0 | frame of document 1 | ... | document index (skippable frame) | seek table (skippable frame)

Every document is one zstandard frame with a content checksum; its payload is the ids as
little-endian unsigned 32-bit integers. The index frame holds the doc_ids (signed 64 bit, the least
value for null). The seek table has, per frame, the compressed size, the content size and the low 32
bits of the content's XXH64, then a 9-byte footer, so a reader finds and decompresses only the
documents it is asked for. A standard zstandard reader can read the file from start to end.

Files lie in the shared folder and are reached through ``pyarrow.fs`` (local, HDFS and object
stores). A task writes a file named by its attempt, and the manifest names the files that count: a retried task
writes another one, and what a lost attempt left is never read.

Edge cases: null text is an empty document (its one id is the end id); null doc_ids come first; rows
that repeat a doc_id are kept (one with very many spans files; inside a file they are ordered by text); an empty table gives no files and no rows; further
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, released, shared_path
from .token_ids import encoded

#: Fixed values of the public seekable zstandard format.
SKIPPABLE_MAGIC, INDEX_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "part int, local long, doc_id long, n_tokens long, ids_crc32 long, ids binary"


def _xxh32(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class StoreWriter:
    """Appends documents to an open binary stream; ``close`` adds the index and the seek table."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.entries, self.ids, self.n_tokens, self.n_bytes = out, [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.n_bytes += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.entries.append((self._put(self.zip.compress(ids)), len(ids), _xxh32(ids)))
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        index = np.asarray(self.ids, "<i8").tobytes()
        packed = self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = np.asarray([*self.entries, (packed, 0, _xxh32(index))], ENTRY)
        table = entries.tobytes() + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class StoreReader:
    """Random access to one file: reads the tail, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.entries = np.frombuffer(self._at(size - 9 - n * ENTRY.itemsize, n * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        index = self._at(int(self.starts[n - 1]), int(self.entries["packed"][-1]))[8:]
        self._verify(index, n - 1, "index")
        self.doc_ids = np.frombuffer(index, "<i8")

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def _verify(self, raw: bytes, k: int, what) -> None:
        if _xxh32(raw) != int(self.entries["check"][k]):
            raise ValueError(f"checksum of {what} does not match")

    def ids(self, k: int) -> bytes:
        """The ids of the ``k``-th document."""
        import zstandard

        e = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(e["packed"])), max_output_size=max(1, int(e["raw"])))
        self._verify(raw, k, f"document {int(self.doc_ids[k])}")
        return raw

    def find(self, doc_id: int | None) -> range:
        key = NULL_ID if doc_id is None else doc_id
        return range(int(np.searchsorted(self.doc_ids, key, "left")), int(np.searchsorted(self.doc_ids, key, "right")))


def open_store(path: str) -> StoreReader:
    from pyarrow import fs

    store, inner = _filesystem(path)
    return StoreReader(store.open_input_file(inner), store.get_file_info(inner).size)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = encoded(batches, tokenizer, end_id)
        first = next(rows, None)
        if first is None:
            return
        part = task.partitionId()
        store, inner = _filesystem(folder)
        store.create_dir(inner, recursive=True)
        # each attempt has a name of its own, so nothing is renamed or replaced; the manifest names the one that counts
        name = f"part-{part:06d}-{task.taskAttemptId()}.zst"
        with store.open_output_stream(f"{inner}/{name}", compression=None) as out:  # frames are packed one by one, not by the name's ending
            w = StoreWriter(out)
            w.add(*first)
            for row in rows:
                w.add(*row)
            w.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(w.ids)]),
             pa.array([w.n_tokens]), pa.array([w.n_bytes])], ["part", "path", "n_docs", "n_tokens", "n_bytes"])

    return write


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files under ``folder``; returns the written manifest.

    One range shuffle by doc_id; each range becomes one file. Offsets of files come from the
    manifest (a row per file), never from the documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or shared_path(spark, "token-store")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    sorted_docs = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
                   .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text"))
    sorted_docs.mapInArrow(released(_writer(f"{folder}/files", tokenizer, end_id)), MANIFEST).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(with_ids: bool, wanted: list | None):
    def read(batches):
        for batch in batches:
            for part, path in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                r = open_store(path)
                picks = range(len(r.doc_ids)) if wanted is None else [k for d in wanted for k in r.find(d)]
                rows = []
                for k in picks:
                    raw = r.ids(k)
                    d = int(r.doc_ids[k])
                    rows.append((part, k, None if d == NULL_ID else d, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "local", "doc_id", "n_tokens", "ids_crc32", "ids"])


def read_store(manifest: DataFrame, with_ids: bool = True, wanted: list | None = None) -> DataFrame:
    """Rows of all documents (or those of ``wanted`` doc_ids), a task per file."""
    n = max(1, manifest.count())
    files = manifest.select("part", "path").repartitionByRange(n, "part")
    return files.mapInArrow(released(_reader(with_ids, wanted)), ROWS)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs``, read the files back: doc_id, start, n_tokens, ids_crc32, part (file)."""
    manifest = write_store(docs, tokenizer, end_id)
    rows = read_store(manifest, with_ids=False)
    before = Window.partitionBy("part").orderBy("local").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.join(F.broadcast(manifest.select("part", "file_start")), "part").select(
        "doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", "part")
