"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Sketch. ``A-Z`` is lower-cased and texts are split at ASCII white space; a text's set is its distinct
   ``n``-word shingles (64-bit hashes), a shorter text is one shingle. One hash per shingle serves all bins: its
   top part names the bin and a bin's value is its least hash, which is the first of the
   bin in the sorted set. Empty bins are filled by optimal densification: each borrows the value of the
   first non-empty bin in an order of its own that is the same for all texts (``_probe_order``). Rows of equal
   sets form a class, of which one goes on.
2. Bands of ``rows`` bins are buckets. A pair at similarity s shares none of ``bands`` buckets with probability
   (1 - s^rows)^bands: 1.3e-7 at 0.8 with 40 bands of 5.
3. Stars. Each bucket's least class is its centre; the candidates are the (member, centre) edges, at most one per
   class and bucket, so their number grows with the buckets' members and not with their squares. Edges that sizes
   rule out are dropped and the others are confirmed on full sets, the members of a large star in chunks. Only
   classes that share a bucket have their texts read again, one row each.
4. Rest. A link between two members that are not both linked to their centre would be lost, so buckets whose
   members (but the centre) still lie in several components are verified as well: the rows outside the
   bucket's largest component against all its rows, in blocks bounded by rows and by shingles. A task holds one
   pair of blocks; only a spanning star of what it links leaves it.

Null ids are a component's least id only where there is no other. Null, empty and blank texts have no set: they link
with nothing, repeated or not. Repeated rows are copies. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, grams, mix, powers, prepare, released, stored, text_bytes, text_key
from .components import components
from .near_dup import linked

SPACE = (0x20, *range(0x09, 0x0E))
#: Byte -> value in a word's hash; 0 for white space only.
SPACED = np.arange(1, 257, dtype=np.uint64)
SPACED[0x41:0x5B] = np.arange(0x62, 0x7C)
SPACED[list(SPACE)] = 0
STAR_CHUNK = 1000


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one text, in pieces of about BLOCK bytes that cut no word."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw):  # back to the last gap; a word longer than a piece stays whole
            gap = np.flatnonzero(SPACED[raw[at:end]] == 0)
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(end + BLOCK, len(raw))
        b = SPACED[raw[at:end]]
        w = np.concatenate([[False], b != 0, [False]])
        s, e = np.flatnonzero(w[1:] & ~w[:-1]), np.flatnonzero(w[:-1] & ~w[1:])
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * powers("up", len(b)), out=sums[1:])
        out.append(mix((sums[e] - sums[s]) * powers("down", len(b) + 1)[s]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles (of all its words where there are fewer)."""
    h = _word_hashes(np.frombuffer(text, np.uint8))
    return np.unique(grams(h, n if len(h) >= n else len(h))) if len(h) else np.zeros(0, np.uint64)


_PROBES: dict[int, np.ndarray] = {}


def _probe_order(bins: int) -> np.ndarray:
    """[i, j]: at which attempt the empty bin i looks into bin j."""
    if bins not in _PROBES:
        rng = np.random.default_rng(11)
        _PROBES[bins] = np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.uint16)
    return _PROBES[bins]


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash values of a sorted non-empty set, densified."""
    # the top 32 bits name the bin; the rest decides, and is spread anew for it
    where = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full = where[first].astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first]
    if len(full) < bins:
        empty = np.ones(bins, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        lender = full[_probe_order(bins)[empty[:, None], full[None, :]].argmin(1)]
        out[empty] = out[lender]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band (the band is part of the key)."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        h = mix(h ^ sig[r * bands: (r + 1) * bands]) + np.uint64(r)
    return h.view(np.int64)


def _sketch(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            off, data = text_bytes(batch.column(2))
            sizes, keys, buckets = [], [], []
            for a, z in zip(off, off[1:]):
                s = shingles(data[a:z].tobytes(), n)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                buckets.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "set_key", "buckets"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            off, data = text_bytes(batch.column(1))
            sets = [shingles(data[a:z].tobytes(), n).tobytes() for a, z in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |A ∩ B| >= percent |A ∪ B|, for sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify_stars(percent: int):
    """Rows (centre, chunk, side, id, shingles), sorted so that a chunk's centre comes before its members."""

    def run(batches):
        centre, own = None, None
        for batch in batches:
            pairs = []
            for c, side, i, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                s = np.frombuffer(raw, np.uint64)
                if side == 0:
                    centre, own = c, s
                elif c == centre and alike(own, s, percent):
                    pairs.append((i, c))
            u, v = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _verify_blocks(percent: int):
    """Rows (bucket, left, right, id, shingles), a unit's rows together: spanning stars of the links in a unit."""

    def unit(rows: list) -> list[tuple[int, int]]:
        ids = [r[0] for r in rows]
        adjacent = linked([np.frombuffer(r[1], np.uint64) for r in rows], percent / 100)
        left, pairs = np.ones(len(ids), bool), []
        for i in range(len(ids)):  # breadth first: a spanning tree of each component
            queue = [i] if left[i] else []
            left[i] = False
            while queue:
                at = queue.pop()
                near = np.flatnonzero(adjacent[at] & left)
                left[near] = False
                pairs += [(ids[j], ids[at]) for j in near]
                queue += near.tolist()
        return pairs

    def run(batches):
        key, rows, pairs = None, [], []
        for batch in batches:
            for bucket, a, b, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, a, b) != key:
                    pairs += unit(rows) if len(rows) > 1 else []
                    key, rows = (bucket, a, b), []
                rows.append((i, raw))
            if len(pairs) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])
                pairs = []
        pairs += unit(rows) if len(rows) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["u", "v"])

    return run


def _star_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed edges (u, v) of the stars."""
    near = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    edges = stored(held.filter((F.col("id") != F.col("centre")) & near).select("id", "centre").distinct(), "star-edges")
    chunks = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_CHUNK).cast("int").alias("chunks"))
    dealt = edges.join(chunks, "centre").select("centre", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id")
    centres = chunks.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("centre").alias("id"))
    rows = dealt.unionByName(centres).join(sets, "id").select("centre", "chunk", "side", "id", "shingles")
    rows = rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "side")
    return stored(rows.mapInArrow(released(_verify_stars(percent)), "u long, v long"), "star-links")


def _rest(held: DataFrame, linked_by_stars: DataFrame, sets: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Links inside buckets that the stars leave in several components, as edges (u, v)."""
    root = linked_by_stars.select("id", "root")
    held = held.filter((F.col("held") > 2) & (F.col("id") != F.col("centre")))
    held = held.join(root, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    held = stored(held, "open-members")
    parts = held.groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    buckets = parts.groupBy("bucket").agg(
        F.max(F.struct("c", "n", "root")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    # buckets of the same members are one
    open_ = buckets.filter("parts > 1").groupBy("c", "n", "h").agg(F.min("bucket").alias("bucket"), F.first("largest").alias("largest"))
    blocks = lambda c, n: F.ceil(F.greatest(c / block, n / block_shingles)).cast("int")
    open_ = open_.select("bucket", F.col("largest.root").alias("main"), blocks(F.col("largest.c"), F.col("largest.n")).alias("main_blocks"),
                         blocks(F.col("c") - F.col("largest.c"), F.col("n") - F.col("largest.n")).alias("light_blocks"))
    rows = held.join(stored(open_, "open-buckets"), "bucket")
    light = F.col("root") != F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(light, F.col("light_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    # light blocks have numbers from 0, blocks of the largest component go on behind them; a unit is a pair of blocks
    rows = rows.select("bucket", "id", light.alias("light"), F.when(light, own).otherwise(own + F.col("light_blocks")).alias("own"), "light_blocks", "main_blocks")
    others = F.when(F.col("light"), F.sequence(F.lit(0), F.col("light_blocks") + F.col("main_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("light_blocks") - 1))
    units = rows.select("bucket", "id", "own", F.explode(others).alias("other")).select(
        "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id").join(sets, "id").select("bucket", "a", "b", "id", "shingles")
    units = units.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "id")
    return stored(units.mapInArrow(released(_verify_blocks(percent)), "u long, v long"), "rest-links")


def dedup(docs: DataFrame, n: int = 2, percent: int = 80, bands: int = 40, rows: int = 5, block: int = 512, block_shingles: int = 500_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id of the documents that links reach; ``kept`` marks the rows that have it
    (of components without ids: all).
    """
    spark = docs.sparkSession
    prepare(spark)
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    sketch = stored(rows_.mapInArrow(released(_sketch(n, bands, rows)), "doc_id long, text_key binary, n long, set_key binary, buckets array<long>"), "oph-sketch")
    # the first row (null ids last) stands for its class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_key")).alias("f")
    classes = sketch.filter("set_key is not null").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key"), "n", "buckets"), "oph-classes")
    members = classes.select(F.explode("buckets").alias("bucket"), "id", "n")
    stars = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.min_by("n", "id").alias("centre_n"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    held = stored(members.join(stars, "bucket"), "bucket-members")
    chosen = classes.select("id", F.col("doc_id").alias("d"), F.col("text_key").alias("k")).join(held.select("id").distinct(), "id", "left_semi")
    texts = rows_.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select("id", "text").dropDuplicates(["id"])
    sets = stored(texts.mapInArrow(released(_sets(n)), "id long, shingles binary"), "oph-sets")
    star_links = _star_links(held, sets, percent)
    by_stars = stored(components(star_links), "oph-components")
    rest = _rest(held, by_stars, sets, percent, block, block_shingles)
    whole = components(by_stars.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(rest))
    named = whole.join(classes.select("id", "doc_id"), "id").groupBy("root").agg(F.min("doc_id").alias("least"))
    of_class = classes.select("set_key", "id", "doc_id").join(whole.join(named, "root").select("id", "least"), "id", "left").select(
        F.col("set_key").alias("k"), F.coalesce("least", "doc_id").alias("least"))
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return sketch.select("doc_id", "n", "set_key").join(of_class, F.col("set_key") == F.col("k"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
