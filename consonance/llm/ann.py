"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner product is turned into least distance: with M the largest norm, an item x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes M q / |q|, so distances fall as inner products rise.
``projections`` random projections give as many sorted arrays per block of items. A query's windows,
centred at its own projections, grow level by level (virtual rehashing: no array is built again);
an item that lies in the windows of ``threshold`` arrays is verified with its exact inner product
in double precision. A query stops when an item as far as its k-th best so far would
have reached the threshold with probability ``recall``; the last window holds everything, so a
query finds ``k`` items wherever there are as many.

Blocks of items (by hash, ``block`` rows) meet blocks of queries; a task holds one block of each,
every item is indexed, and a query's results are the best of its blocks' results. A first round takes one
block of items; the k-th best score that a query found there bounds its windows in all other blocks, which therefore
begin where an item that may still be among the k best would be found, and end there.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and
rows without an id, take no part. Of rows that repeat an id, the least vector stands for it. Ties go to
the smaller id. An empty table or query set gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

FOUND = "query_id long, vec_id long, score double"
LEVEL_RATIO, FIRST_LEVEL, FIRST_CHUNK, QUERY_CHUNK = 1.2, 0.1, 16, 128
READ_COST = 12   # reading one item of a window costs as much as looking up so many places


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): finite, non-zero vectors of the most frequent length (the shorter of equally frequent ones)."""
    x = F.col(vec_col).cast("array<double>")
    infinite = float("inf")
    good = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite)) & F.exists("x", lambda v: v != 0))
    best = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.filter(F.size("x") == (best[0].d if best else 0)).groupBy("vec_id").agg(F.min("x").alias("x"))


def stop_probability(projections: int, threshold: int, recall: float) -> float:
    """The least collision probability with which ``threshold`` of ``projections`` collide with probability ``recall``."""
    def reached(p: float) -> float:
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1))

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reached(mid) >= recall else (mid, hi)
    return hi


def _half_width(p: float) -> float:
    """w with P(|N(0, 1)| <= w) = p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf((1 + p) / 2)


class Block:
    """Sorted projections of one block of items (fewer than 2^16), and each item's place in each sorted array."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, projections: int):
        self.ids, self.x, self.norm = ids, x, norm
        rng = np.random.default_rng(5)
        self.axes = rng.standard_normal((x.shape[1] + 1, projections))
        tail = np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
        p = x @ self.axes[:-1] + tail[:, None] * self.axes[-1]
        order = np.argsort(p, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.uint16))
        self.places = np.empty((projections, len(ids)), np.uint16)
        np.put_along_axis(self.places, order.T, np.arange(len(ids), dtype=np.uint16)[None, :], 1)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)
        self.first_width = FIRST_LEVEL * norm

    def _ends(self, centres: np.ndarray, width: float) -> np.ndarray:
        """Windows around the queries' projections as (query, projection, first place and length)."""
        sides = centres[:, :, None] + np.array([-width, width])
        if width > self.widest:
            sides = np.broadcast_to(np.array([-np.inf, np.inf]), sides.shape)
        ends = np.stack([s.searchsorted(sides[:, i]) for i, s in enumerate(self.sorted)], 1)
        return np.stack([ends[:, :, 0], ends[:, :, 1] - ends[:, :, 0]], 2).astype(np.uint16)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int, threshold: int, stop_width: float) -> list[tuple[int, int, float]]:
        """(query, item, score) of the best ``k`` found for each query.

        ``known``: per query a score that ``k`` other items have (nan: none). Windows of a query that has one begin and end at the
        distance of such an item; windows of later ones without begin near the width at which earlier ones stopped.
        """
        self.widest = 2 * self.norm * stop_width
        if not np.isnan(known).any():
            return self._bounded(query_ids, queries, known, k, threshold, stop_width)
        out = []
        for at, end in pairwise([0, *range(FIRST_CHUNK, len(query_ids), QUERY_CHUNK), len(query_ids)]):
            qs = queries[at:end]
            lengths = np.sqrt((qs * qs).sum(1))
            centres = (qs * (self.norm / lengths)[:, None]) @ self.axes[:-1]
            width, levels = self.first_width, {}
            stops = []
            for j, (qid, q) in enumerate(zip(query_ids[at:end], qs)):
                found, scores, level = self._one(int(qid), q, float(lengths[j]), centres, j, levels, width, k, threshold, stop_width)
                stops.append(width * LEVEL_RATIO**level)
                out += self._best(int(qid), q, found, scores, k)
            self.first_width = min(self.widest, float(np.quantile(stops, 0.25)))
        return out

    def _bounded(self, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int, threshold: int, stop_width: float) -> list[tuple[int, int, float]]:
        """One window per query and array, as wide as its known score asks for."""
        out = []
        for at in range(0, len(query_ids), QUERY_CHUNK):
            qs = queries[at: at + QUERY_CHUNK]
            lengths = np.sqrt((qs * qs).sum(1))
            centres = (qs * (self.norm / lengths)[:, None]) @ self.axes[:-1]
            # the k-th best cannot be farther than the known item; a little wider, as it may lie just there
            width = np.sqrt(np.maximum(0.0, 2 * self.norm**2 - 2 * self.norm * known[at: at + QUERY_CHUNK] / lengths)) * stop_width * (1 + 1e-9)
            low = np.stack([s.searchsorted(c) for s, c in zip(self.sorted, (centres - width[:, None]).T)])
            high = np.stack([s.searchsorted(c, "right") for s, c in zip(self.sorted, (centres + width[:, None]).T)])
            for j, (qid, q) in enumerate(zip(query_ids[at: at + QUERY_CHUNK], qs)):
                counts = self._collisions(low[:, j], high[:, j])
                found = np.flatnonzero((counts >= threshold) & (self.ids != qid))
                scores = self.x[found] @ q
                near = scores >= known[at + j] - 1e-9 * max(1.0, self.norm * float(np.abs(q).sum()))
                out += self._best(int(qid), q, found[near], scores[near], k)
        return out

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each item lies in the window [low, high): its place is looked up, or, where windows hold few
        items, the windows are read."""
        if (high - low).sum() * READ_COST < self.places.size:
            return np.bincount(np.concatenate([o[a:z] for o, a, z in zip(self.order, low, high)]), minlength=len(self.ids))
        first, span = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        return ((self.places - first) < span).sum(0, dtype=np.uint16)

    def _one(self, qid: int, q: np.ndarray, length: float, centres, j: int, levels: dict, width: float, k: int, threshold: int, stop_width: float):
        fresh_of, scores, own = np.zeros(len(self.ids), bool), np.zeros(0), self.ids == qid
        level, found = 0, np.zeros(0, np.int64)
        while True:
            w = width * LEVEL_RATIO**level
            if level not in levels:
                levels[level] = self._ends(centres, w)
            first, span = levels[level][j].T[:, :, None]
            # an item collides in an array if its place lies in the window there
            counts = ((self.places - first) < span).sum(0, dtype=np.uint16)
            fresh = np.flatnonzero((counts >= threshold) & ~fresh_of & ~own)
            fresh_of[fresh] = True
            found = np.concatenate([found, fresh])
            scores = np.concatenate([scores, self.x[fresh] @ q])
            if w > self.widest or len(found) >= k and self._far(scores, k, length) * stop_width <= w:
                return found, scores, level
            level += 1

    def _best(self, qid: int, q: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k best by exact scores: all that come near the k-th are computed again row by row, so equal vectors tie."""
        if len(found) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth - 1e-9 * max(1.0, self.norm * float(np.abs(q).sum()))
            found = found[near]
        exact = (self.x[found] * q).sum(1)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return [(qid, int(self.ids[found[i]]), float(exact[i])) for i in best]

    def _far(self, scores: np.ndarray, k: int, length: float) -> float:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        return math.sqrt(max(0.0, 2 * self.norm**2 - 2 * self.norm * float(kth) / length))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in rows.column("x").chunks]).to_numpy() if len(ids) else np.zeros(0)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _search(norm: float, k: int, projections: int, threshold: int, stop_width: float):
    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if items.num_rows and queries.num_rows:
            block = Block(*_matrix(items), norm, projections)
            known = queries.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
            ids = queries.column("vec_id").to_numpy()
            known = known[np.argsort(ids, kind="stable")]
            for some in (np.isnan(known), ~np.isnan(known)):
                if some.any():
                    qids, x = _matrix(queries)
                    out += block.search(qids[some], x[some], known[some], k, threshold, stop_width)
        ids, vecs, scores = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vecs, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, projections: int = 64, collisions: float = 0.5, recall: float = 0.9,
            block: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each vector with ``is_query``, best first."""
    prepare(vectors.sparkSession)
    items = stored(usable(vectors), "vectors")
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    n, norm, n_queries = items.agg(F.count(F.lit(1)), F.sqrt(F.max(norm2)), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    threshold = max(1, math.ceil(collisions * projections))
    width = _half_width(stop_probability(projections, threshold, recall))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    here = lambda count, seed, name: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int").alias(name)
    block_of, query_block_of = here(blocks, 1, "b"), here(query_blocks, 2, "qb")
    search = _search(float(norm or 0.0), k, projections, threshold, width)

    def round_of(rows: DataFrame, queries: DataFrame, tasks: int) -> DataFrame:
        """``rows(vec_id, x, b, qb)`` against ``queries(vec_id, x, known, b, qb)``."""
        left, right = rows.repartition(tasks, "b", "qb").groupBy("b", "qb"), queries.repartition(tasks, "b", "qb").groupBy("b", "qb")
        return left.cogroup(right).applyInArrow(search, FOUND)

    # first round: the first block of items
    own = items.select("vec_id", "x", block_of)
    asked = items.filter(is_query).select(F.col("vec_id").alias("qid"), F.col("x").alias("qx"), query_block_of).withColumnsRenamed({"qid": "vec_id", "qx": "x"})
    first = stored(round_of(own.filter("b = 0").select("*", every(query_blocks, "qb")), asked.select("vec_id", "x", F.lit(None).cast("double").alias("known"), F.lit(0).alias("b"), "qb"), query_blocks), "first-block")
    found = first
    if blocks > 1:
        # of fewer than k finds the last is no bound
        known = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).select(
            F.col("query_id").alias("q"), F.when(F.col("c") >= k, F.col("s")).alias("known"))
        bounded = asked.join(known, F.col("vec_id") == F.col("q"), "left").select(
            "vec_id", "x", "known", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("b"), "qb")
        rest = round_of(own.filter("b > 0").select("*", every(query_blocks, "qb")), bounded, (blocks - 1) * query_blocks)
        found = first.unionByName(rest)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
