"""Hard-negative mining with segment summaries that bound inner products.

A vector is cut into segments of neighbouring components; a segment's summary is its mean and its deviation (the
length of what is left when the mean is taken off). Over a segment of w components, the product of two vectors is
w times the product of the means, plus or minus at most the product of the deviations. Summed over the
segments this gives a lower and an upper bound of the score. ``Side`` stores the summaries for 1, 2, 4, … segments; bounds of
a pair get tighter from level to level, and a pair that cannot be among the wanted is left before the next one.
What no level rules out is scored exactly.

Vectors become integers, floor(256 x) by component. Anchors go to the tasks in slices of about ``slice_anchors``
(broadcast; so is a slice's table of positives), all rows are read where they lie, and a task hands on
only its best rows per anchor. First round: an anchor's best rows of its own label (positives). Second round: for each
positive the best rows of other labels whose score lies between the given percentages of the
positive's. Within a task the k-th best so far is the bound that later pairs have to reach.

How much the bounds rule out depends on the vectors: it is much where means differ or the length lies in few
segments, and little for directions drawn evenly from a sphere. Results are exact either way.

Rows without id, label or vector, with null or non-finite components, without components, or of another length than
most take no part. Repeated rows are rows of their own. Ties go to the smaller id. A positive of score 0 or less
has no negatives (its range is empty, or 0 alone). Scores must stay below 2^53, else ValueError. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, stored
from .topk import TopK, best

NONE = -(1 << 62)
ITEMS, ANCHORS, SPARSE = 1000, 1024, 0.1
RESULT = "anchor long, slot long, id long, score long"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(row_id, id, label, x): integer vectors of the most frequent length (the shorter of equally frequent ones)."""
    raw = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), raw.alias("x")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("x") > 0))
    scaled = good.withColumn("x", F.transform("x", lambda v: F.floor(v * 256).cast("long"))).withColumn("row_id", F.monotonically_increasing_id())
    kept = stored(scaled.select("row_id", "id", "label", "x"), "integer-vectors")
    top = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    kept = kept.filter(F.size("x") == (top.d if top else 0))
    most = kept.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] or 0
    if top and most * most * top.d >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    return kept


class Side:
    """Vectors with the summaries (mean times the root of w, deviation) of 1, 2, 4, … segments."""

    def __init__(self, x: np.ndarray):
        self.x, self.levels, count = x, [], 1
        squares, d = x * x, x.shape[1]
        while count < d:
            edges = np.arange(count) * d // count
            mean = np.add.reduceat(x, edges, axis=1) / np.sqrt(np.diff(np.append(edges, d)))
            deviation = np.sqrt(np.maximum(np.add.reduceat(squares, edges, axis=1) - mean * mean, 0))
            self.levels.append((mean, deviation))
            count *= 2
        self.length = float(np.sqrt(squares.sum(1).max())) if len(x) else 0.0

    def part(self, a: int, z: int) -> Side:
        out = Side.__new__(Side)
        out.x, out.length = self.x[a:z], self.length
        out.levels = [(m[a:z], d[a:z]) for m, d in self.levels]
        return out


def pairs_in_range(a: Side, b: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, score) of all allowed pairs with low <= score <= high (per row of ``a``).

    Bounds are matrix products while many pairs are left, and are computed pair by pair after that.
    """
    slack = 1e-9 * a.length * b.length + 1e-6
    alive, few = allowed, None

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x @ y.T if few is None else np.einsum("ij,ij->i", x[few[0]], y[few[1]])

    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels):
        if few is None and np.count_nonzero(alive) <= SPARSE * alive.size:
            few = np.nonzero(alive)
        middle, spread = product(mean_a, mean_b), product(dev_a, dev_b) + slack
        lo, hi = (low[:, None], high[:, None]) if few is None else (low[few[0]], high[few[0]])
        fits = (middle + spread >= lo) & (middle - spread <= hi)
        if few is None:
            alive = alive & fits
        else:
            few = few[0][fits], few[1][fits]
    score = np.rint(product(a.x, b.x)).astype(np.int64)
    if few is None:
        few = np.nonzero(alive)
        score = score[few]
    good = (score >= low[few[0]]) & (score <= high[few[0]])
    return few[0][good], few[1][good], score[good]


def _chunks(batches, rows: int):
    """Tables of about ``rows`` rows: (row_id, id, label, matrix)."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield _arrays(held)
            held = []
    if sum(b.num_rows for b in held):
        yield _arrays(held)


def _arrays(batches: list):
    t = pa.Table.from_batches(batches)
    flat = np.concatenate([c.flatten().to_numpy() for c in t.column("x").chunks]).astype(np.float64)
    return *(t.column(c).to_numpy() for c in ("row_id", "id", "label")), flat.reshape(t.num_rows, -1)


def _found(top: TopK, slots: int) -> pa.RecordBatch:
    key, score, ids = top.cut()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key // slots, key % slots, ids, score)], ["anchor", "slot", "id", "score"])


def _positives(anchors, k: int):
    """A task's ``k`` best other rows of each anchor's label."""

    def run(batches):
        row_ids, labels, x = anchors.value
        whole, top = Side(x), TopK(len(row_ids), k, NONE)
        for rows, ids, label, matrix in _chunks(batches, ITEMS):
            items = Side(matrix)
            for at in range(0, len(row_ids), ANCHORS):
                part = slice(at, at + ANCHORS)
                allowed = (labels[part, None] == label) & (row_ids[part, None] != rows)
                i, j, score = pairs_in_range(whole.part(at, at + ANCHORS), items, allowed, top.floor[part], np.full(len(row_ids[part]), np.inf))
                top.add(i + at, score, ids[j])
            top.cut()
        yield _found(top, 1)

    return run


def _negatives(anchors, ranges, k: int):
    """A task's ``k`` best rows of other labels in each range (anchor, slot: low and high, low > high where there is none)."""

    def run(batches):
        row_ids, labels, x = anchors.value
        low, high = ranges.value
        slots = low.shape[1]
        whole, top = Side(x), TopK(low.size, k, NONE)
        for _, ids, label, matrix in _chunks(batches, ITEMS):
            items = Side(matrix)
            for at in range(0, len(row_ids), ANCHORS):
                part = slice(at, at + ANCHORS)
                least = np.maximum(low[part], top.floor.reshape(low.shape)[part])
                some = low[part] <= high[part]
                i, j, score = pairs_in_range(whole.part(at, at + ANCHORS), items, labels[part, None] != label,
                                             np.where(some, least, np.iinfo(np.int64).max).min(1), np.where(some, high[part], NONE).max(1))
                for s in range(slots):
                    inside = some[i, s] & (score >= least[i, s]) & (score <= high[part][i, s])
                    top.add((i[inside] + at) * slots + s, score[inside], ids[j[inside]])
            top.cut()
        yield _found(top, slots)

    return run


def _ranges(scores: np.ndarray, known: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with least * p <= 100 s <= most * p for each positive score p."""
    low, high = -((-least * scores) // 100), (most * scores) // 100
    return np.where(known, low, 1), np.where(known, high, 0)


def _slice(items: DataFrame, anchors: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame | None:
    spark = items.sparkSession
    sc = spark.sparkContext
    rows = anchors.collect()  # bounded by the slice
    if not rows:
        return None
    given = sc.broadcast((np.array([r.row_id for r in rows]), np.array([r.label for r in rows]), np.array([r.x for r in rows], np.float64)))
    order = [F.desc("score"), F.asc("id")]
    task = F.spark_partition_id()

    def merged(run, k: int, keys: list[str]) -> DataFrame:
        found = stored(items.mapInArrow(released(run), RESULT).withColumn("task", task), "negatives")
        tasks = found.select(F.max("task")).first()[0] or 0
        return best(found, keys, k, order, "task", math.isqrt(tasks + 1))

    first = merged(_positives(given, positives), positives, ["anchor"]).collect()  # at most ``positives`` rows per anchor of the slice
    ids, scores, known = (np.zeros((len(rows), positives), t) for t in (np.int64, np.int64, bool))
    for r in first:
        ids[r.anchor, r.rank - 1], scores[r.anchor, r.rank - 1], known[r.anchor, r.rank - 1] = r.id, r.score, True
    if not known.any():
        return None
    second = merged(_negatives(given, sc.broadcast(_ranges(scores, known, least, most)), negatives), negatives, ["anchor", "slot"])
    names = spark.createDataFrame([(i, s, rows[i].id, int(ids[i, s]), int(scores[i, s])) for i, s in zip(*(x.tolist() for x in np.nonzero(known)))],
                                  "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
    return stored(second.join(names, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         slice_anchors: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, label, embedding)``.

    ``is_anchor``: a condition on ``id``; ``label``: the label to use, from the table's columns; ``least`` and
    ``most``: per cent of the positive's score.
    """
    spark = vectors.sparkSession
    prepare(spark)
    items = usable(vectors, label)
    anchors = items.filter(is_anchor)
    slices = max(1, -(-anchors.count() // slice_anchors))
    part = F.pmod(F.xxhash64("row_id"), F.lit(slices))
    found = [x for i in range(slices) if (x := _slice(items, anchors.filter(part == i), positives, negatives, least, most)) is not None]
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
