"""Shared helpers of the training-data operators: reading, row identity, vectorised words and shingles.

Words: ``A-Z`` lower-cased, then maximal runs of digits, ``a-z`` and non-ASCII characters. On UTF-8
bytes this is one table lookup (every byte of a non-ASCII character is 0x80 or more), so a whole
Arrow batch is cut into words and hashed with numpy, without a Python object per word.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_library

ARROW_ROWS = 250
BLOCK = 1 << 20

WORD_BYTES = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    WORD_BYTES[_b] = _b
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of long texts small."""
    ship_library(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (one per call)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run):
    """``run`` over Arrow batches, giving freed memory back to the system when a task ends: workers are
    kept for later stages, which need the executor's memory for other things."""
    def task(batches):
        yield from run(batches)
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; with ``doc_id`` they identify a row up to repeated rows."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def crc32_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and UTF-8 bytes of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]: off[-1]]


_POWERS: dict[str, np.ndarray] = {}
_BASE = {"up": 0x9E3779B97F4A7C15, "down": pow(0x9E3779B97F4A7C15, -1, 1 << 64)}


def powers(name: str, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base ("up") or its inverse ("down") modulo 2^64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK + 1), _BASE[name], np.uint64)
        p[0] = 1
        have = _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cuts(off: np.ndarray, data: np.ndarray) -> list[int]:
    """Block bounds of about BLOCK bytes that cut no word."""
    cuts, n = [0], len(data)
    while n - cuts[-1] > BLOCK:
        at = cuts[-1] + BLOCK
        k = int(np.searchsorted(off, at, "right")) - 1
        if off[k] > cuts[-1]:
            at = int(off[k])
        else:
            gap = np.flatnonzero(WORD_BYTES[data[cuts[-1]: at]] == 0)
            if len(gap):
                at = cuts[-1] + int(gap[-1]) + 1
            else:
                end = int(off[np.searchsorted(off, at, "left")])
                gap = np.flatnonzero(WORD_BYTES[data[at:end]] == 0)
                at = at + int(gap[0]) if len(gap) else end
        cuts.append(at)
    return cuts + [n] if cuts[-1] < n or n == 0 else cuts


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and the index of each text's first word (n + 1)."""
    st, en, hs = [], [], []
    cuts = _cuts(off, data)
    for a, z in zip(cuts, cuts[1:]):
        if z == a:
            continue
        b = WORD_BYTES[data[a:z]]
        w = b != 0
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        inner = off[(off >= a) & (off < z)] - a
        first[inner] = w[inner]
        inner = off[(off > a) & (off <= z)] - a - 1
        last[inner] = w[inner]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * powers("up", len(b)), out=sums[1:])
        hs.append(mix((sums[e] - sums[s]) * powers("down", len(b))[s]))
        st.append(s + a)
        en.append(e + a)
    if not st:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    starts = np.concatenate(st)
    return starts, np.concatenate(en), np.concatenate(hs), np.searchsorted(starts, off, "left")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on (also across texts: callers keep windows inside one)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, c in enumerate(powers("up", n + 1)[1:]):
        out += h[k: k + m] * c
    return mix(out ^ np.uint64(n))


def shingle_sets(off: np.ndarray, data: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word shingles; a text of fewer words, but not none, is one."""
    _, _, h, first = words(off, data)
    g, out = grams(h, n), []
    for a, z in zip(first, first[1:]):
        if z - a >= n:
            out.append(np.unique(g[a: z - n + 1]))
        else:
            out.append(grams(h[a:z], int(z - a)) if z > a else np.zeros(0, np.uint64))
    return out
