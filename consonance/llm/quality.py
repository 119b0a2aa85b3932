"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass turns each text into a vector of transformed statistics (shares of character classes,
lengths, repetition). Per class, counts, sums and outer products are added up by Spark over all
labelled training rows, so the fit needs no sample; covariances are shrunk to the pooled one and to
its diagonal, and their Cholesky factors are computed once. A score is the logistic of the
prior-weighted difference of the two Mahalanobis log densities.

Null and empty texts have the statistics of an empty text and a score. Repeated rows are scored one
by one; in training, each labelled row counts. With one class only (or no label) scores are that
class's prior (one half without any). Null labels and labels other than 0 and 1 take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, prepare, released, stored, text_bytes, words

STATISTICS = ("log_bytes", "upper", "digit", "blank", "lines", "stops", "symbols", "rare_symbols", "beyond_ascii",
              "word_length", "word_spread", "distinct_words", "distinct_grams", "distinct_lines")
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "lines": b"\n", "stops": b".,;:?'\"-()",
           "symbols": b"!#$%&*", "rare_symbols": b"|<>{}[]=+/\\^~_@`"}


def _shares(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)


def _distinct(h: np.ndarray, a: int, z: int) -> float:
    return len(np.unique(h[a:z])) / (z - a) if z > a else 1.0


def statistics(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = len(off) - 1
    x = np.zeros((n, len(STATISTICS)))
    size = np.diff(off)
    x[:, 0] = np.log1p(size)
    for k, (_, chars) in enumerate(CLASSES.items(), start=1):
        flags = np.zeros(256, bool)
        flags[list(chars)] = True
        x[:, k] = np.sqrt(_shares(flags[data], off))
    x[:, 8] = np.sqrt(_shares(data >= 0x80, off))
    st, en, h, first = words(off, data)
    long = np.concatenate([[0], np.cumsum(en - st)])
    square = np.concatenate([[0], np.cumsum((en - st) ** 2)])
    count = np.maximum(np.diff(first), 1)
    mean = (long[first[1:]] - long[first[:-1]]) / count
    x[:, 9] = np.log1p(mean)
    x[:, 10] = np.log1p(np.sqrt(np.maximum((square[first[1:]] - square[first[:-1]]) / count - mean**2, 0)))
    five = grams(h, 5)
    for i in range(n):
        a, z = first[i], first[i + 1]
        x[i, 11] = _distinct(h, a, z)
        x[i, 12] = _distinct(five, a, z - 4)
        lines = data[off[i]: off[i + 1]].tobytes().split(b"\n")
        x[i, 13] = len(set(lines)) / len(lines)
    return x


def _statistics_of(batches):
    for batch in batches:
        off, data = text_bytes(batch.column(1))
        x = statistics(off, data)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["key", "x"])


def document_statistics(docs: DataFrame, key: Column) -> DataFrame:
    """(key, x) per row; ``key`` may be a struct of any columns."""
    prepare(docs.sparkSession)
    rows = docs.select(key.alias("key"), F.col("text"))
    return rows.mapInArrow(released(_statistics_of), f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


def _moments(batches):
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.asarray(batch.column(0))
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for c in (0, 1):
        if total[c, 0]:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c].tolist()], pa.list_(pa.float64()))], ["label", "sums"])


class QuadraticDiscriminant:
    """Means, Cholesky factors and priors of the two classes on standardised statistics."""

    def __init__(self, sums: dict[int, np.ndarray], d: int, to_pooled: float, to_diagonal: float):
        counts = {c: s[0] for c, s in sums.items()}
        n = sum(counts.values())
        self.prior = {c: (counts.get(c, 0) + 0.5) / (n + 1) for c in (0, 1)}
        self.ready = all(counts.get(c, 0) >= 2 for c in (0, 1))
        if not self.ready:
            return
        mean = {c: s[1: d + 1] / s[0] for c, s in sums.items()}
        cov = {c: s[d + 1:].reshape(d, d) / s[0] - np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = sum(counts[c] * cov[c] for c in (0, 1)) / n
        self.centre, self.scale = sum(counts[c] * mean[c] for c in (0, 1)) / n, np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        z = np.outer(self.scale, self.scale)
        pooled = pooled / z
        self.parts = {}
        for c in (0, 1):
            own = (1 - to_pooled) * cov[c] / z + to_pooled * pooled
            own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.maximum(np.diag(own), 1e-2))
            factor = np.linalg.cholesky(own)
            self.parts[c] = ((mean[c] - self.centre) / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        prior = np.log(self.prior[1] / self.prior[0])
        if not self.ready:
            return np.full(len(x), prior)
        x = (x - self.centre) / self.scale
        density = {c: -0.5 * ((((x - m) @ w.T) ** 2).sum(1) + logdet) for c, (m, w, logdet) in self.parts.items()}
        return density[1] - density[0] + prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(rows: DataFrame, to_pooled: float = 0.3, to_diagonal: float = 0.02) -> QuadraticDiscriminant:
    """From ``rows(label, x)``; at most 2 x (1 + d + d^2) sums reach the driver."""
    d = len(STATISTICS)
    good = rows.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "x")
    parts = good.mapInArrow(_moments, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "v"))
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.label, np.zeros(1 + d + d * d))[r["at"]] = r.v
    return QuadraticDiscriminant(sums, d, to_pooled, to_diagonal)


def _scores_of(model: QuadraticDiscriminant):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["key", "score"])

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the doc_id as text falls into fold 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _train(x: DataFrame, labels: DataFrame) -> QuadraticDiscriminant:
    """From ``x(key, x)``, whose key holds ``doc_id``, and the ``labels(doc_id, quality)`` that are not held out."""
    train = labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return fit(x.join(train, F.col("key.doc_id") == F.col("id")).select("label", "x"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, score) of every row of ``docs(doc_id, text)``; ``key`` is a struct of its ``doc_id``."""
    x = stored(document_statistics(docs, F.struct("doc_id")), "document-statistics")
    model = _train(x, labels)
    return x.mapInArrow(released(_scores_of(model)), f"key {x.schema['key'].dataType.simpleString()}, score double")


def _keep_of(model: QuadraticDiscriminant, text_at: int, threshold: float):
    def run(batches):
        for batch in batches:
            x = statistics(*text_bytes(batch.column(0).field(text_at)))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return run


def keep(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``docs`` whose score reaches the threshold, with all their columns.

    Statistics are computed once for the fit (kept without texts) and again in the pass that filters, so
    that no text is shuffled or copied for the fit.
    """
    model = _train(stored(document_statistics(docs.select("doc_id", "text"), F.struct("doc_id")), "document-statistics"), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(released(_keep_of(model, docs.columns.index("text"), threshold)), rows.schema).select("doc.*")
