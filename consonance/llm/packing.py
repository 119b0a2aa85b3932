"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with the end id) are cut into pieces of a full window as long as that goes; such
a piece is a sequence without padding. Remainders are cut into pieces of at most ``max_piece`` ids and
gathered in blocks of about ``block`` windows. Within a block the largest differencing method
spreads the pieces over ``k`` windows: partial partitions, each a vector of ``k`` window sums, wait in a
heap by their spread; the two of largest spread are merged with opposing order (largest sums against
smallest) until one is left. ``k`` starts at the least count that can hold the block and rises
whenever a window exceeds its capacity. Blocks follow the input partitions, so packing needs no
shuffle and a task holds one block of ids.

Padding per block is ``k * capacity`` less its ids: about the mean slack left on purpose
(``slack`` ids a window) and, for the last block of a partition, less than one window more.

Edge cases: null text counts as empty (one piece, the end id); repeated rows and doc_ids are packed
like any others; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released
from .token_ids import encoded

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, by multiway differencing."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    heap, nodes = [], []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        nodes.append(None)
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        sums = x + y[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        nodes.append((a, b, order.astype(np.int32)))
        heapq.heapreplace(heap, (-int(sums[-1]), len(nodes) - 1, sums))
    where, todo = np.zeros(n, np.int64), [(heap[0][1], np.arange(k))]
    while todo:  # slot -> window, from the last merge down to the items
        node, windows = todo.pop()
        if nodes[node] is None:
            where[node] = windows[-1]
            continue
        a, b, order = nodes[node]
        merged = np.empty(k, np.int64)
        merged[order] = windows
        todo += [(a, merged), (b, merged[::-1])]
    return where


def balanced_windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows of items of at most ``capacity`` each; the count rises until none is overfull."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        where = differencing(sizes, k)
        if np.bincount(where, sizes, k).max(initial=0) <= capacity:
            return where, k
        k += 1


class Packer:
    """Fed with documents, yields pieces ``(doc_id, start, ids, doc_tokens, sequence_id, offset)``."""

    def __init__(self, capacity: int, block: int, max_piece: int, slack: float, first_sequence: int = 0):
        self.capacity, self.max_piece, self.sequence = capacity, max_piece, first_sequence
        self.full = int(block * (capacity - slack))
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: bytes):
        n, cap = len(ids) // 4, self.capacity
        for start in range(0, n - n % cap, cap):
            yield doc_id, start, ids[4 * start: 4 * (start + cap)], n, self.sequence, 0
            self.sequence += 1
        start = n - n % cap
        while start < n:
            size = min(n - start, self.max_piece, self.full - self.held)
            self.waiting.append((doc_id, start, ids[4 * start: 4 * (start + size)], n))
            self.held += size
            start += size
            if self.held == self.full:
                yield from self.flush()

    def flush(self):
        """Pack what waits."""
        where, k = balanced_windows([len(p[2]) // 4 for p in self.waiting], self.capacity)
        at = [0] * k
        for p, w in zip(self.waiting, where):
            yield (*p, self.sequence + int(w), at[w])
            at[w] += len(p[2]) // 4
        self.sequence += k if self.waiting else 0
        self.waiting, self.held = [], 0


def _pieces_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, ids, total, seq, offset = zip(*rows)
    longs = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, seq, offset]
    cols = [pa.array(c, pa.int64()) for c in longs] + [pa.array(ids if with_ids else [None] * len(ids), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PIECES.split(", ")])


def _pack(tokenizer: str, end_id: int, capacity: int, block: int, max_piece: int, slack: float, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        packer, rows = Packer(capacity, block, max_piece, slack, TaskContext.get().partitionId() << 36), []
        for doc_id, ids in encoded(batches, tokenizer, end_id):
            for piece in packer.add(doc_id, ids):
                rows.append(piece)
                if len(rows) >= 2000:
                    yield _pieces_batch(rows, with_ids)
                    rows = []
        rows += packer.flush()
        if rows:
            yield _pieces_batch(rows, with_ids)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, block: int = 256,
         max_piece: int = 512, slack: float = 4.0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents and their places; ``sequence_id`` is unique, ``offset`` gapless from 0."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = rows.mapInArrow(released(_pack(tokenizer, end_id, capacity, block, max_piece, slack, with_ids)), PIECES)
    return out if with_ids else out.drop("ids")
