"""Benchmark decontamination by a broadcast hash set of normalised word windows.

A window is ``window`` consecutive words of a benchmark item (words as in ``common``); an item of fewer
words, but not none, is one window. Windows are hashed, and the sorted hashes of one slice of at most
``max_slice`` windows are broadcast. A task hashes all word windows of its Arrow batch at once, looks
them up, and verifies each hit on the words themselves. A benchmark of more windows than a slice holds
is handled in several passes, each with its own bounded broadcast, whose hits add up.

Rows keep all their columns inside the struct ``doc``, so no name can clash with the results. Null and
empty texts have no words and no hits. Items without words have no window; a window of an item whose
id is null hits, but names no item. Repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, grams, prepare, released, stored, text_bytes, words

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])
HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                        ("spans", pa.list_(pa.list_(pa.int64())))])


def _spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(WORD_BYTES[data[a:b]].tobytes() for a, b in zip(starts, ends))


def _item_windows(window: int):
    def run(batches):
        for batch in batches:
            off, data = text_bytes(batch.column(1))
            st, en, h, first = words(off, data)
            out = []
            for item, a, z in zip(batch.column(0).to_pylist(), first, first[1:]):
                n = int(min(window, z - a))
                if n:
                    g = grams(h[a:z], n).view(np.int64)
                    out += [(n, int(g[i - a]), _spell(data, st[i: i + n], en[i: i + n]), item) for i in range(a, z - n + 1)]
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["n", "h", "words", "item"])

    return run


def item_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Distinct windows (n, h, words) with the ids of the items that hold them."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    return rows.mapInArrow(released(_item_windows(window)), "n int, h long, words binary, item string").groupBy(
        "n", "h", "words").agg(F.collect_set("item").alias("items"))


def _lookup(rows) -> dict:
    """n -> (sorted hashes, hash -> [(words, items)])."""
    by_n: dict[int, dict] = {}
    for r in rows:
        by_n.setdefault(r.n, {}).setdefault(r.h, []).append((bytes(r.words), list(r["items"])))
    return {n: (np.sort(np.fromiter(d, np.int64, len(d))), d) for n, d in by_n.items()}


def _scan(lookup, text_at: int):
    def judge(texts: pa.Array, before: list | None) -> list[dict]:
        off, data = text_bytes(texts)
        st, en, h, first = words(off, data)
        doc_of = np.repeat(np.arange(len(off) - 1), np.diff(first))
        found: dict[int, tuple[set, set]] = {}
        for n, (keys, entries) in lookup.value.items():
            g = grams(h, n).view(np.int64)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for i in np.flatnonzero((keys[at] == g) & (doc_of[: len(g)] == doc_of[n - 1:])):
                spelt = _spell(data, st[i: i + n], en[i: i + n])
                for known, items in entries[int(g[i])]:
                    if known == spelt:
                        d = int(doc_of[i])
                        spans, names = found.setdefault(d, (set(), set()))
                        spans.add((int(i - first[d]), int(i - first[d]) + n))
                        names.update(items)
        out = []
        for d in range(len(off) - 1):
            spans, names = found.get(d, (set(), set()))
            if before is not None and before[d]["spans"]:
                spans, names = spans | {tuple(s[:2]) for s in before[d]["spans"]}, names | set(before[d]["items"])
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            base, k = int(off[d]), int(first[d])
            char = lambda p: len(data[base:p].tobytes().decode("utf-8"))
            out.append({"n_words": int(first[d + 1] - first[d]), "n_hit": sum(b - a for a, b in merged), "items": sorted(names),
                        "spans": [[a, b, char(int(st[k + a])), char(int(en[k + b - 1]))] for a, b in merged]})
        return out

    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            before = batch.column(1).to_pylist() if batch.num_columns > 1 else None
            hits = pa.array(judge(doc.field(text_at), before), HITS_ARROW)
            yield pa.RecordBatch.from_arrays([doc, hits], ["doc", "hits"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_slice: int = 250_000) -> DataFrame:
    """``doc`` (all columns) and ``hits``: n_words, n_hit, items, spans.

    A span is [first word, word after the last, first character, character after the last], merged
    where windows overlap or touch.
    """
    spark = docs.sparkSession
    prepare(spark)
    wins = stored(item_windows(benchmark, window), "benchmark-windows")
    slices = max(1, -(-wins.count() // max_slice))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([out.schema["doc"], T.StructField("hits", HITS)])
    for k in range(slices):
        part = wins.filter(F.pmod(F.xxhash64("n", "h", "words"), F.lit(slices)) == k).collect() if slices > 1 else wins.collect()
        found = spark.sparkContext.broadcast(_lookup(part))
        out = out.mapInArrow(released(_scan(found, docs.columns.index("text"))), schema)
        if k + 1 < slices:
            out = stored(out, "benchmark-hits")
    return out


def contaminated(hits: Column, one_in: int = 20) -> Column:
    """At least one hit, and hits make up a share of 1 / ``one_in`` of the words or more."""
    return (hits["n_hit"] > 0) & (hits["n_hit"] * one_in >= hits["n_words"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the characters of its hit spans."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s[3]))
    begins = F.concat(F.transform(spans, lambda s: s[2]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(ends, begins, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = 13) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without their hit spans."""
    found = scan(docs, benchmark, window)
    bad = contaminated(F.col("hits"))
    cols = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    if remove == "documents":
        return found.filter(~bad).select(*cols)
    text = F.when(bad, without_spans(F.col("doc.text"), F.col("hits.spans"))).otherwise(F.col("doc.text"))
    return found.select(*[text.alias("text") if c == "text" else x for c, x in zip(docs.columns, cols)])
