"""Incremental scoring of newly arrived rows with Structured Streaming.

What a micro-batch adds to a group's scores is written as partial sums that add up (Gram cells; token
counts for LUQ), each micro-batch once: the tables are ``SnapshotTable``s that remember the last micro-batch. Nothing
that arrived earlier is read again, whatever a group holds, and a group that most rows belong to is spread
by its cells or tokens like any other. Tables are compacted by adding sums up, so readers
see a bounded number of folders.

State that Spark keeps is what tells repeated rows apart, and it is bounded by time:

* Moments: a vector (group and key) that arrives again within ``horizon`` of its first arrival is not counted again
  (``dropDuplicatesWithinWatermark`` on the time of arrival).
* LUQ: of a response (group and index) that arrives again within ``ttl_ms`` of its last arrival, the new text takes the place of
  the old one: the state holds the text, and its sums are taken back. Of several texts in one micro-batch the greatest counts.

A row that comes back later than that is late, and counts as a further vector or response. Rows are never
late by their own content. All folders lie under the session's shared checkpoint folder unless the caller names another.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as TX
from ..operators import vectors as V
from ..session import checkpoint_dir
from ..sources.snapshots import SnapshotTable

#: What a query with Python state needs: a store that knows its operators, and no further micro-batches without data
#: (a time to live would ask for one after the other, without end).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
MAX_FOLDERS = 8


def _source(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def _run(writer, base: str) -> list[dict]:
    """Consume what is available; the progress of each micro-batch."""
    q = writer.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").start()
    q.awaitTermination()
    return [p.asDict() if hasattr(p, "asDict") else p for p in q.recentProgress]


def state_rows(progress: list[dict]) -> list[int]:
    """Rows of state after each micro-batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


@contextmanager
def _state_conf(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- moments

def _cells(spark: SparkSession, path: str, group_cols: list[str]) -> SnapshotTable:
    return SnapshotTable(spark, path, group_cols, buckets=16)


def run_incremental_spectra(spark: SparkSession, source: str, schema: T.StructType, group_cols: list[str], key_col: str,
                            vec_col: str, work_dir: str | None = None, max_files_per_trigger: int = 1,
                            horizon: str = "7 days", progress: list | None = None) -> str:
    """Consume everything available under ``source`` and return the folder of the table of Gram cells.

    Vectors without a finite, non-zero norm are left out, as in the batch form. ``progress`` receives each
    micro-batch's progress.
    """
    base = work_dir or f"{checkpoint_dir(spark)}/incremental-spectra"
    arrived = _source(spark, source, schema, max_files_per_trigger).withColumn("_arrived", F.current_timestamp())
    new = arrived.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark([*group_cols, key_col])

    def fold(batch: DataFrame, epoch: int) -> None:
        table = _cells(batch.sparkSession, f"{base}/cells", group_cols)
        good, _rejected = V.normalize_rows(batch, vec_col)
        cells = V.gram_partials(good.select(*group_cols, F.col(vec_col).cast("array<double>").alias("_x")), group_cols)
        table.append(V.sum_cells(cells, group_cols), ("stream", epoch))
        table.compact(lambda rows: V.sum_cells(rows, group_cols), MAX_FOLDERS)

    done = _run(new.writeStream.foreachBatch(fold), base)
    if progress is not None:
        progress += done
    return f"{base}/cells"


def latest_spectra(spark: SparkSession, cells_dir: str, group_cols: list[str]) -> DataFrame:
    return V.spectra_from_cells(V.sum_cells(_cells(spark, cells_dir, group_cols).read(), group_cols), group_cols)


# ---------------------------------------------------------------- LUQ

class LatestText(StatefulProcessor):
    """Per response: the text that counts. Emits (key…, text, sign): a text that takes its place, 1, and one that is
    taken back, -1."""

    def __init__(self, key_cols: list[str], text_col: str, ttl_ms: int):
        self.text_col, self.ttl_ms, self.names = text_col, ttl_ms, [*key_cols, text_col, "sign"]

    def init(self, handle) -> None:
        self.held = handle.getValueState("text", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        # a null text stands below every other; null and text are told apart by a mark before the text
        new = max("" if r[self.text_col] is None else "+" + r[self.text_col] for r in rows)
        old = self.held.get()[0] if self.held.exists() else None
        self.held.update((new,))
        if old == new:
            return
        for text, sign in ((old, -1), (new, 1)):
            if text is not None:
                yield Row(**dict(zip(self.names, (*key, text[1:] if text else None, sign))))

    def close(self) -> None:
        pass


def luq_sums(changes: DataFrame, group_cols: list[str], text_col: str) -> DataFrame:
    """Partial sums ``(group…, tok, w, df, k, own, bare)`` of responses with a ``sign``.

    LUQ with the lexical scorer needs Σ_i Σ_s∈i (1/n_i|T(s)|) Σ_{t∈T(s)} (df(t) − [t in r_i]) per group, n_i the statements of
    response i. So per token: ``w`` = Σ 1/(n_i |T(s)|) over the statements that hold it, and ``df`` its responses; per group (null token): ``k``
    responses, ``own`` = Σ_i of the share of i's statements that have tokens (what [t in r_i] adds up to), and ``bare`` responses without statements.
    """
    g, text = group_cols, F.col(text_col)
    sets = F.transform(F.coalesce(TX.statements(text), F.array().cast("array<string>")), lambda s: F.array_distinct(TX.tokens(s)))
    r = changes.select(*g, "sign", text.alias("_text"), F.explode(F.array(F.struct(sets.alias("t")))).alias("_s"))  # evaluated once
    n, sign = F.size("_s.t"), F.col("sign")
    zero = F.lit(0).cast("long")

    def entry(tok, w=None, df=None, k=None, own=None, bare=None) -> Column:
        real = lambda x: F.lit(0.0) if x is None else x.cast("double")
        whole = lambda x: zero if x is None else x.cast("long")
        return F.struct(tok.alias("tok"), real(w).alias("w"), whole(df).alias("df"), whole(k).alias("k"), real(own).alias("own"), whole(bare).alias("bare"))

    stated = F.flatten(F.transform("_s.t", lambda t: F.transform(t, lambda x: entry(x, w=sign / (n * F.size(t))))))
    held = F.transform(F.coalesce(F.array_distinct(TX.tokens(F.col("_text"))), F.array().cast("array<string>")), lambda x: entry(x, df=sign))
    with_tokens = F.size(F.filter("_s.t", lambda t: F.size(t) > 0))
    whole = entry(F.lit(None).cast("string"), k=sign, own=F.when(n > 0, sign * with_tokens / n).otherwise(0.0), bare=F.when(n == 0, sign).otherwise(0))
    return add_up(r.select(*g, F.inline(F.concat(stated, held, F.array(whole)))), g)


def add_up(sums: DataFrame, group_cols: list[str]) -> DataFrame:
    return sums.groupBy(*group_cols, "tok").agg(*[F.sum(c).alias(c) for c in ("w", "df", "k", "own", "bare")])


def luq_from_sums(sums: DataFrame, group_cols: list[str]) -> DataFrame:
    """``(group…, uncertainty)``; null for a single response or where a response has no statements (as ``luq``)."""
    total = add_up(sums, group_cols).groupBy(*group_cols).agg(
        F.sum(F.col("w") * F.col("df")).alias("p"), F.sum("own").alias("own"), F.sum("k").alias("k"), F.sum("bare").alias("bare"))
    k = F.col("k")
    return total.select(*group_cols, F.when((k > 1) & (F.col("bare") == 0), 1 - (F.col("p") - F.col("own")) / (k * (k - 1))).alias("uncertainty"))


def _sums(spark: SparkSession, path: str, group_cols: list[str], buckets: int) -> SnapshotTable:
    return SnapshotTable(spark, path, group_cols, buckets)


def run_incremental_luq(spark: SparkSession, source: str, schema: T.StructType, group_cols: list[str],
                        idx_col: str, text_col: str, buckets: int = 16, work_dir: str | None = None,
                        max_files_per_trigger: int = 1, ttl_ms: int = 7 * 86_400_000, progress: list | None = None) -> str:
    """J1 for LUQ (G3/G4); returns the folder of the table of sums, read with ``latest_luq``."""
    base = work_dir or f"{checkpoint_dir(spark)}/incremental-luq"
    keys = [*group_cols, idx_col]
    out = T.StructType([schema[c] for c in keys] + [T.StructField(text_col, T.StringType()), T.StructField("sign", T.IntegerType())])
    new = _source(spark, source, schema, max_files_per_trigger).select(*keys, text_col)

    def fold(changes: DataFrame, epoch: int) -> None:
        table = _sums(changes.sparkSession, f"{base}/sums", group_cols, buckets)
        table.append(luq_sums(changes, group_cols, text_col), ("stream", epoch))
        table.compact(lambda rows: add_up(rows, group_cols), MAX_FOLDERS)

    with _state_conf(spark):
        changes = new.groupBy(*keys).transformWithState(LatestText(keys, text_col, ttl_ms), out, "Update", "ProcessingTime")
        done = _run(changes.writeStream.outputMode("update").foreachBatch(fold), base)
    if progress is not None:
        progress += done
    return f"{base}/sums"


def latest_luq(spark: SparkSession, sums_dir: str, group_cols: list[str]) -> DataFrame:
    return luq_from_sums(_sums(spark, sums_dir, group_cols, 1).read(), group_cols)
