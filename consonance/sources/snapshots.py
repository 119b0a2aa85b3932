"""Parquet tables whose versions are manifests: atomic replace (A11, A3), upserts and merges that read and
write only the key buckets they touch (A12, A14), and appends that are counted once (J1).

Layout below a table's folder::

    data/<new folder per write>/b=<bucket>/…parquet
    manifests/<version>.json     bucket -> its folders; schema; marks

A write makes a new data folder and then one manifest. The manifest's file is created under the next number and
never overwritten, so of two writers one fails; it ends in a digest of itself, so one that is
not complete is not there. Readers take the highest complete manifest and see one version whole; a write that fails
leaves the table as it was, and folders that no manifest names are cleared by ``vacuum``. Rows lie in
the bucket of their key's hash, so rows of one key are in one bucket. Files go through Hadoop's file system:
any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "b"
FILES = 4


class Conflict(RuntimeError):
    """Another writer made the version first; read again and repeat."""


class SnapshotTable:
    """A table at ``path`` whose rows are known by ``key_cols``; ``buckets`` is fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, key_cols: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), list(key_cols), buckets

    # ------------------------------------------------------------ files

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self, name: str) -> dict | None:
        fs, path = self._hadoop(f"manifests/{name}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, digest = text.rpartition("\n")
        return json.loads(body) if digest and hashlib.sha256(body.encode()).hexdigest() == digest else None

    def manifest(self) -> dict:
        """The newest complete version (version 0: nothing written yet)."""
        for name in reversed(self._names("manifests")):
            if (m := self._load(name)) is not None:
                return m
        return {"version": 0, "buckets": self._buckets, "keys": self.keys, "schema": None, "folders": {}, "marks": {}}

    def _commit(self, old: dict, **changed) -> dict:
        taken = self._names("manifests")  # an incomplete one keeps its number
        new = old | changed | {"version": max(old["version"], int(taken[-1].split(".")[0]) if taken else 0) + 1}
        if any(int(n.split(".")[0]) > old["version"] and self._load(n) is not None for n in taken):
            raise Conflict(f"{self.path}: version {old['version']} is no longer the newest")
        body = json.dumps(new, sort_keys=True)
        fs, path = self._hadoop(f"manifests/{new['version']:012d}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:  # noqa: BLE001 - py4j wraps the file system's own exception
            if "exist" in str(e):
                raise Conflict(f"{self.path}: version {new['version']} was made by another writer") from e
            raise
        stream.write(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode())
        stream.close()
        return new

    # ------------------------------------------------------------ reading

    def bucket(self, manifest: dict):
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.keys]), F.lit(manifest["buckets"])).cast("int")

    def _read(self, m: dict, buckets: list[str] | None = None) -> DataFrame | None:
        if m["schema"] is None:
            return None
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, folders in m["folders"].items() if buckets is None or b in buckets for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The newest version, or None where nothing was written."""
        return self._read(self.manifest())

    def marks(self) -> dict:
        return self.manifest()["marks"]

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, m: dict) -> tuple[str, list[str]]:
        """A new data folder and its buckets. Rows are dealt by bucket; AQE splits large ones and joins small ones (without it,
        as in a stream, a bucket goes to up to ``FILES`` tasks)."""
        folder = uuid.uuid4().hex
        dealt = rows.withColumn(BUCKET, self.bucket(m))
        if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            dealt = dealt.hint("rebalance", BUCKET)
        else:
            dealt = dealt.repartition(BUCKET, F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)))
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        return folder, [n.partition("=")[2] for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]

    def replace(self, rows: DataFrame) -> None:
        """``rows`` instead of the table."""
        m = self.manifest()
        folder, buckets = self._write(rows, m)
        self._commit(m, schema=rows.schema.jsonValue(), folders={b: [folder] for b in buckets})

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> bool:
        """Add rows. With ``mark`` = (source, number), numbers up to the last one of that source are not added again."""
        m = self.manifest()
        if mark is not None and m["marks"].get(mark[0], -1) >= mark[1]:
            return False
        folder, buckets = self._write(rows, m)
        folders = {**m["folders"], **{b: [*m["folders"].get(b, []), folder] for b in buckets}}
        marks = {**m["marks"], **({mark[0]: mark[1]} if mark else {})}
        self._commit(m, schema=m["schema"] or rows.schema.jsonValue(), folders=folders, marks=marks)
        return True

    def rewrite(self, new: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Buckets that ``new`` touches become ``fold(their old rows, new)``; other buckets are neither read nor
        written. ``fold`` must keep keys in place (it sees all rows of every touched bucket). Returns the touched buckets."""
        m = self.manifest()
        if m["schema"] is None:
            m = m | {"schema": new.schema.jsonValue()}
        touched = [str(r[0]) for r in new.select(self.bucket(m)).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return []
        merged = fold(self._read(m, touched), new)
        folder, buckets = self._write(merged, m)
        folders = {b: f for b, f in m["folders"].items() if b not in touched} | {b: [folder] for b in buckets}
        self._commit(m, folders=folders)
        return sorted(touched)

    def upsert(self, new: DataFrame, order_col: str) -> list[str]:
        """The last write of a key counts (see ``io.upsert_latest``)."""
        from .io import upsert_latest

        return self.rewrite(new, lambda old, rows: upsert_latest(old, rows, self.keys, order_col))

    def extend(self, new: DataFrame, key_cols: list[str], idx_col: str = "response_idx", batch_col: str = "batch") -> list[str]:
        """New responses extend their keys' lists (see ``io.merge_extend``); ``key_cols`` are the table's keys."""
        from .io import merge_extend

        if list(key_cols) != self.keys:
            raise ValueError("lists are extended by the keys of the table")
        return self.rewrite(new, lambda old, rows: merge_extend(old, rows, key_cols, idx_col, batch_col))

    def compact(self, fold: Callable[[DataFrame], DataFrame], max_folders: int = 16) -> list[str]:
        """Buckets of more than ``max_folders`` folders become one of ``fold(rows)``, which must give rows that stand for
        the same content (such as partial sums added up). Returns the compacted buckets."""
        m = self.manifest()
        long = [b for b, folders in m["folders"].items() if len(folders) > max_folders]
        if not long:
            return []
        folder, buckets = self._write(fold(self._read(m, long)), m)
        self._commit(m, folders={b: f for b, f in m["folders"].items() if b not in long} | {b: [folder] for b in buckets})
        return sorted(long)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and data folders that none of these names. Call it when no
        reader is on an older version and no write is under way."""
        names = [n for n in self._names("manifests") if self._load(n) is not None]
        live = {f for n in names[-keep:] for folders in self._load(n)["folders"].values() for f in folders}
        for folder, gone in (("manifests", names[:-keep]), ("data", [n for n in self._names("data") if n not in live])):
            for name in gone:
                fs, path = self._hadoop(f"{folder}/{name}")
                fs.delete(path, True)
