"""The best ``k`` rows per key over Arrow batches, and over the results of many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TopK:
    """Of rows (key, score, tie) the first ``k`` per key by falling score, then rising tie; keys are 0 … n - 1.

    Rows are kept until ``room`` of them are held, then cut to the best; ``floor`` is the score that a key's next
    row has to reach (``least`` while fewer than ``k`` are known).
    """

    def __init__(self, n: int, k: int, least: int):
        self.k, self.floor = k, np.full(n, least, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.room = 0, max(50_000, 4 * n * k)

    def add(self, key: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        self.fresh.append((key, score, tie))
        self.held += len(key)
        if self.held > self.room:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        """(key, score, tie), sorted, after the others are dropped."""
        key, score, tie = (np.concatenate(c) for c in zip(self.rows, *self.fresh))
        order = np.lexsort((tie, -score, key))
        key, score, tie = key[order], score[order], tie[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.k
        last = place == self.k - 1
        self.floor[key[last]] = np.maximum(self.floor[key[last]], score[last])
        self.rows, self.fresh, self.held = [key[kept], score[kept], tie[kept]], [], int(kept.sum())
        return self.rows


def best(found: DataFrame, keys: list[str], k: int, order: list, salt: str, salts: int) -> DataFrame:
    """The first ``k`` rows per key with their ``rank`` from 1, cut in two steps: per key and salt, then per key."""
    part = F.pmod(F.col(salt), F.lit(max(1, salts))).alias("_salt")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = found.select("*", part).withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
