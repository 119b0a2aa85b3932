"""N-gram Jaccard join: prefixes of MinHash trees, then exact verification.

1. Each text becomes the set of its distinct ``n``-word shingles (64-bit hashes; words as in ``common``).
   Texts of one set form a class, of which one row goes on: copies cost one aggregation, no pairs.
2. ``trees`` lists of MinHash values per class, read up to one depth: the longest, from ``max_depth`` down, at which a
   pair at the threshold shares the prefix of some tree with probability ``recall`` (7 values of each of 64
   trees for 0.999999). The depth follows from the parameters alone, it is not chosen class by class. Classes
   under one prefix are candidates of each other; a pair that shares none is lost (1 in 3.6 million at 0.8 exactly).
3. Classes that share prefixes, directly or over others, form candidate groups (stars to each
   prefix's least member, then connected components). Groups are cut into blocks of ``block`` classes by
   hash, and each pair of blocks is a task's unit: exact intersections of all its set pairs come
   from products of 0/1 matrices. What leaves a unit is, per class, its number of links and its root in
   the unit: the pairs themselves are never written or shuffled, however large a group is.
4. Links are added up, roots are joined to linked groups by connected components.

A link is a Jaccard similarity of ``threshold`` or more between different sets. Texts with fewer than
``n`` words, but not none, are one shingle; null, empty and word-less texts link to nothing and are
groups of their own, row by row. A group's class id is its least doc_id (null only if all are null).
Repeated rows are copies. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, shingle_sets, stored, text_bytes, text_key
from .components import components

TILE_COLUMNS = 4096


def prefix_depth(threshold: float, trees: int, recall: float, max_depth: int) -> int:
    """The longest prefix, from ``max_depth`` down, that reaches the recall at the threshold."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (rows: non-empty sets, columns: ``n`` functions)."""
    xors, odds = _seeds(n)
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n), np.uint32)
    for j in range(n):
        v = (low ^ xors[j]) * odds[j]
        v ^= v >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), begin)
    return out


def _labels(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """One 64-bit prefix per set and tree."""
    sig = signatures(sets, trees * depth).astype(np.uint64).reshape(len(sets), trees, depth)
    h = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = np.broadcast_to(h, (len(sets), trees)).copy()
    for d in range(depth):
        h = (h ^ sig[:, :, d]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _sketch(n: int, trees: int, depth: int, chunk: int = 256):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                sets = shingle_sets(*text_bytes(batch.column(2)), n)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                labels: list = [None] * len(sets)
                if some:
                    for i, row in zip(some, _labels([sets[i] for i in some], trees, depth).tolist()):
                        labels[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(labels, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "set_key", "labels"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(*text_bytes(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs whose exact Jaccard similarity reaches the threshold (no self links)."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), TILE_COLUMNS):
        i, j = np.searchsorted(column, [a, a + TILE_COLUMNS])
        tile = np.zeros((n, TILE_COLUMNS), np.float32)
        tile[row[i:j], column[i:j] - a] = 1
        common += tile @ tile.T
    both = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * both - 1e-9
    np.fill_diagonal(out, False)
    return out


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """Least index of each row's component."""
    root = np.arange(len(adjacent))
    while True:
        near = np.where(adjacent, root[None, :], len(root)).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify_unit(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], pair: bool, threshold: float):
    """(id, links, root id) for the classes of one unit that have links or, in a diagonal one, copies."""
    adjacent = linked(sets, threshold)
    if pair:  # pairs inside one block belong to that block's own unit
        adjacent &= side[:, None] != side[None, :]
    some = adjacent.any(1)
    root = ids[_roots(adjacent)]
    links = adjacent @ copies
    return [(int(ids[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(some)]


def _verify(threshold: float):
    """Rows (group, left, right, id, block, copies, shingles), a unit's rows together and sorted."""

    def unit(rows: list[tuple]):
        _, left, right = rows[0][:3]
        ids, side, copies = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        return _verify_unit(ids, side, copies, [np.frombuffer(r[6], np.uint64) for r in rows], left != right, threshold)

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != key:
                    if len(rows) > 1:
                        out += unit(rows)
                    key, rows = r[:3], []
                rows.append(r)
            if len(out) > 10_000:
                yield _links_batch(out)
                out = []
        if len(rows) > 1:
            out += unit(rows)
        if out:
            yield _links_batch(out)

    return run


def _links_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "links", "root"])


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 64, recall: float = 0.999999,
         max_depth: int = 16, block: int = 512) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, class_id, n_links, n_copies, grp.

    ``n_links``: other documents whose set is linked to, or equal to, the document's; ``n_copies``: documents of the
    same set, itself included; ``text_key`` identifies the text; ``grp`` numbers the linked groups, with or
    without ids (null: no words).
    """
    spark = docs.sparkSession
    prepare(spark)
    depth = prefix_depth(threshold, trees, recall, max_depth)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text"))
    sketch = stored(rows.mapInArrow(released(_sketch(n, trees, depth)), "doc_id long, text_key binary, set_key binary, labels array<long>"), "sketch")

    # classes of equal sets, numbered; the first row (null ids last) stands for the class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_key"))
    grouped = sketch.filter("set_key is not null").groupBy("set_key").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"))
    classes = stored(grouped.select(
        F.monotonically_increasing_id().alias("id"), "set_key", F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key"),
        "copies", "labels"), "classes")

    # stars from each shared prefix's least member
    members = classes.select("id", F.posexplode("labels").alias("tree", "prefix"))
    stars = members.groupBy("tree", "prefix").agg(F.min("id").alias("v"), F.max("id").alias("top")).filter("v < top")
    edges = members.join(stars.select("tree", "prefix", "v"), ["tree", "prefix"]).select(F.col("id").alias("u"), "v")
    groups = stored(components(edges), "groups")

    # blocks of large groups; a class goes to one unit per other block of its group
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    chosen = placed.join(classes.select("id", "doc_id", "text_key", "copies"), "id")
    texts = rows.join(chosen.select("id", F.col("doc_id").alias("d"), F.col("text_key").alias("k")),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    sets = texts.select("id", "text").dropDuplicates(["id"]).mapInArrow(released(_sets(n)), "id long, shingles binary")
    sets = stored(sets, "shingles")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = chosen.select("root", "id", "block", "copies", other).select(
        F.col("root").alias("grp"), F.least("block", "other").alias("l"), F.greatest("block", "other").alias("r"), "id", "block", "copies")
    units = units.join(sets, "id").select("grp", "l", "r", "id", "block", "copies", "shingles")
    units = units.repartition("grp", "l", "r").sortWithinPartitions("grp", "l", "r", "id")
    found = stored(units.mapInArrow(released(_verify(threshold)), "id long, links long, root long"), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked_groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = linked_groups.join(classes.select("id", "doc_id"), "id").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_class = (classes.select("id", "set_key", "doc_id", "copies").join(links, "id", "left")
                .join(linked_groups.join(named, "root").select("id", "root", "class_id"), "id", "left"))
    of_class = of_class.select(F.col("set_key").alias("s"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("root", "id").alias("grp"),
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    own = F.col("set_key").isNull()
    return sketch.select("doc_id", "text_key", "set_key").join(of_class, F.col("set_key") == F.col("s"), "left").select(
        "doc_id", "text_key", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(own, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), "grp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each linked group: of least doc_id (rows without one last), then of least text key,
    whether or not ids are given or repeat. Texts without words are a group with their equals; null and empty texts are
    no groups: one row per doc_id stays."""
    found = join(docs, **options)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    empty = F.col("text_key") == text_key(F.lit(""))
    group = F.when(F.col("grp").isNotNull(), F.concat(F.lit("g"), F.col("grp").cast("string"))).when(
        empty, F.concat(F.lit("e"), ident)).otherwise(F.concat(F.lit("t"), F.hex("text_key")))
    first = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_key")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("_keep_id"), F.col("f.text_key").alias("_keep_text"))
    struct = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = struct.withColumn("_text", text_key(F.col("doc.text")))
    kept = keyed.join(first, F.col("doc.doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text") == F.col("_keep_text")))
    one = kept.groupBy("_keep_id", "_keep_text").agg(F.first("doc").alias("doc"))
    return one.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
