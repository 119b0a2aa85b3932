"""Vector and kernel operators over embedding groups (dispersion family).

A group is a set of K vectors (one per response). The cosine kernel Z = U Uᵀ
of the unit rows is never materialised as a pair table here: every quantity
below depends on Z only through its spectrum or its Frobenius norm, and those
equal the spectrum / norm of the d×d Gram UᵀU. Two operators give the same numbers:

* ``group_spectra``, for groups whose K×d matrix is small by construction: a batched numpy
  kernel over partitions sorted by group (many groups per Arrow batch, stacked eigen-solvers);
* ``group_spectra_gram``, for groups of any size, which are never gathered: every part of a
  group gives a partial d×d Gram (``mapInPandas``), Spark sums the partials of groups of several
  parts with a native aggregation, and one d×d eigen-problem per group finishes the job.

The caller chooses by what bounds the groups; nothing switches by size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_group

# Fixed parameter defaults of the dispersion family.
JITTER = 1e-3          # added to the kernel diagonal before the eigen-decomposition
EIGENSCORE_ALPHA = 1e-3  # ridge in the eigen-score log-determinant
HELD_BYTES = 128 << 20  # of partial Grams that a task holds before it hands them on
ENTROPY_FLOOR = 1e-10  # zero probabilities are replaced by this in discrete entropy

SUMMARY_FIELDS = [
    ("k", T.LongType()),
    ("dispersion", T.DoubleType()),
    ("dispersion_norm", T.DoubleType()),
    ("eigenscore", T.DoubleType()),
    ("trace", T.DoubleType()),
    ("fro2", T.DoubleType()),
    ("mean_cos", T.DoubleType()),
    ("purity", T.DoubleType()),
    ("renyi2", T.DoubleType()),
]


# ---------------------------------------------------------------- column helpers

def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def unit_vector(v: Column) -> Column:
    """divide every element by the row norm, computing the norm once.

    ``transform(v, x -> x / norm(v))`` would be re-evaluated per element after
    Catalyst collapses the projection; ``zip_with`` against an ``array_repeat``
    of the norm keeps it a single evaluation per row.
    """
    v = v.cast("array<double>")
    n = l2_norm(v)
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m)


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def cosine(u: Column, v: Column) -> Column:
    """cosine similarity of two vector columns (null if either norm is 0)."""
    u = u.cast("array<double>")
    v = v.cast("array<double>")
    den = l2_norm(u) * l2_norm(v)
    return F.when(den > 0, dot(u, v) / den)


def normalize_rows(df: DataFrame, vec_col: str, out_col: str = "u") -> tuple[DataFrame, DataFrame]:
    """F1 with quarantine: returns (unit rows, rejected rows with ``reason``).

    The unit-norm assertion of the original becomes a data check: zero or
    non-finite vectors cannot be normalised and go to the reject frame.
    """
    with_norm = df.withColumn("_norm", l2_norm(F.col(vec_col).cast("array<double>")))
    ok = F.col("_norm").isNotNull() & (F.col("_norm") > 0) & ~F.isnan("_norm") & (F.col("_norm") < float("inf"))
    good = with_norm.filter(ok).withColumn(
        out_col, F.zip_with(F.col(vec_col).cast("array<double>"),
                            F.array_repeat(F.col("_norm"), F.size(vec_col)), lambda x, m: x / m)
    ).drop("_norm")
    bad = with_norm.filter(~ok | F.col("_norm").isNull()).drop("_norm").withColumn(
        "reason", F.lit("zero or non-finite vector norm"))
    return good, bad


# ---------------------------------------------------------------- numpy kernels

def _entropy(p: np.ndarray) -> float:
    """Discrete entropy with the zero floor."""
    p = np.array(p, dtype=np.float64)
    p[p == 0] = ENTROPY_FLOOR
    return float(-np.sum(p * np.log(p)))


def _top_eigs(gram: np.ndarray, k: int) -> np.ndarray:
    """The K eigenvalues of the K×K kernel from either Gram form.

    For a d×d Gram with K > d the remaining K-d eigenvalues are exactly zero;
    with K < d only the top K are the kernel's (the rest are numerically 0).
    """
    ev = np.linalg.eigvalsh(gram)[::-1]
    ev = np.clip(ev, 0.0, None)
    if len(ev) >= k:
        return ev[:k]
    return np.concatenate([ev, np.zeros(k - len(ev))])


def _summary(k: int, gu: np.ndarray, gc: np.ndarray, s: np.ndarray, tr: float,
             jitter: float, alpha: float) -> dict:
    lam = _top_eigs(gu, k)
    disp = _entropy((lam + jitter) / k)
    mu = _top_eigs(gc, k)
    eigenscore = float(np.sum(np.log(mu + alpha)) / k)
    fro2 = float(np.sum(gu * gu))
    mean_cos = float((s @ s - tr) / (k * (k - 1))) if k > 1 else None
    purity = fro2 / (k * k)
    return {
        "k": k,
        "dispersion": disp,
        "dispersion_norm": disp / np.log(k) if k > 1 else None,
        "eigenscore": eigenscore,
        "trace": float(tr),
        "fro2": fro2,
        "mean_cos": mean_cos,
        "purity": purity,
        "renyi2": float(-np.log(purity)),
    }


def _unit_and_centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / n, x - x.mean(axis=1, keepdims=True)


def _summary_schema(group_schema: list[T.StructField]) -> T.StructType:
    return T.StructType(list(group_schema) + [T.StructField(n, t, True) for n, t in SUMMARY_FIELDS])


# ---------------------------------------------------------------- group spectra

def group_spectra(vectors: DataFrame, group_cols: list[str], vec_col: str,
                  jitter: float = JITTER, alpha: float = EIGENSCORE_ALPHA) -> DataFrame:
    """F3/F4/F6/F7 per group: dispersion (von Neumann entropy of Z + jitter·I over K,
    eigenvalues not renormalised), dispersion / ln K, eigen-score of the raw rows,
    and kernel moments (trace, ‖Z‖²_F, mean off-diagonal cosine, purity, Rényi-2).

    For groups that fit in a task by construction (a question's K sampled responses). Groups
    without such a bound are scored by ``group_spectra_gram``. Rows must have non-zero
    vectors (use ``normalize_rows`` to quarantine).
    """
    data = vectors.select(*group_cols, F.col(vec_col).cast("array<double>").alias("_x"))
    return _direct(data, group_cols, _summary_schema([data.schema[c] for c in group_cols]), jitter, alpha)


def group_spectra_gram(vectors: DataFrame, group_cols: list[str], vec_col: str,
                       jitter: float = JITTER, alpha: float = EIGENSCORE_ALPHA) -> DataFrame:
    """the scores of ``group_spectra`` for groups of any size: rows are dealt into parts of about ``PART_ROWS`` d rows, each of
    which makes one partial d×d Gram, and one d×d eigen-problem per group finishes the job.

    The Gram of a group of one part is whole and finished where it is made; those of larger groups leave their
    tasks as cells, which a native sum adds up: fewer numbers than their rows.
    """
    data = vectors.select(*group_cols, F.col(vec_col).cast("array<double>").alias("_x"))
    width = data.select(F.size("_x").alias("d")).first()
    schema = _summary_schema([data.schema[c] for c in group_cols])
    if width is None:
        return data.sparkSession.createDataFrame([], schema)
    rows = _dealt(data, group_cols, PART_ROWS * width.d)
    whole = _finished(rows.filter("_chunks = 1"), group_cols, [], schema, jitter, alpha)
    cells = _part_cells(rows.filter("_chunks > 1"), group_cols)
    return whole.unionByName(spectra_from_cells(sum_cells(cells, group_cols), group_cols, jitter, alpha))


PART_ROWS = 16        # times d: rows whose partial Gram is made in one place


def _dealt(data: DataFrame, group_cols: list[str], chunk: int) -> DataFrame:
    """``data`` with ``_chunks``, in how many chunks of about ``chunk`` rows its group is dealt, and ``salt``, which of them it is in."""
    from .graphs import with_group_row

    chunks = data.groupBy(*group_cols).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_chunks"))
    rows = with_group_row(data.withColumn("node", F.xxhash64("_x", F.monotonically_increasing_id())), chunks, group_cols)
    return rows.select(*group_cols, "_chunks", F.pmod("node", F.col("_chunks")).cast("int").alias("salt"), "_x")


def group_spectra_wide(vectors: DataFrame, group_cols: list[str], vec_col: str, jitter: float = JITTER,
                       alpha: float = EIGENSCORE_ALPHA, chunk_rows: int | None = None) -> DataFrame:
    """F3–F7 for vectors of model width (d in the thousands) and groups of any size.

    Groups of up to ``chunk_rows`` rows (4 d by default) are scored by the direct kernel, from whichever Gram is smaller. The rows
    of larger groups are dealt into chunks of that size. The Grams of chunks that make up 4 d rows are added up in one task; a group
    of no more is finished there. Else the sums leave their task as tiles of ``TILE`` numbers, so what
    is shuffled is at most about a quarter of the vectors, a task holds one pair of Grams at a time, and tiles are added up in steps
    (``_merged``). All give the same scores; one group's d² numbers meet in one task for its eigenvalues.
    """
    data = vectors.select(*group_cols, F.col(vec_col).cast("array<double>").alias("_x"))
    width = data.select(F.size("_x").alias("d")).first()
    schema = _summary_schema([data.schema[c] for c in group_cols])
    if width is None:
        return data.sparkSession.createDataFrame([], schema)
    chunk = chunk_rows or 4 * width.d
    together = max(1, 4 * width.d // chunk)   # chunks of a group whose Grams are added up in one task
    rows = _dealt(data, group_cols, chunk)
    out = _direct(rows.filter("_chunks = 1").select(*group_cols, "_x"), group_cols, schema, jitter, alpha)
    if together > 1:
        middle = rows.filter((F.col("_chunks") > 1) & (F.col("_chunks") <= together))
        out = out.unionByName(_finished(middle, group_cols, ["salt"], schema, jitter, alpha))
    large = rows.filter(F.col("_chunks") > together).withColumn("part", F.floor(F.col("salt") / F.lit(together)).cast("int"))
    cells = _merged(_chunk_tiles(large, group_cols), [*group_cols, "tile"], "mean")
    names, n_cells = [f.name for f in schema.fields], width.d**2 + 2 * width.d + 2

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {g: pdf[g].iloc[0] for g in group_cols}
        row.update(_summary_of_cells(np.concatenate(pdf.sort_values("tile")["x"].to_numpy())[:n_cells], jitter, alpha))
        return pd.DataFrame([row], columns=names)

    return out.unionByName(cells.select(*group_cols, "tile", "x").groupBy(*group_cols).applyInPandas(finish, schema=schema))


def _grams(batches, keys: list[str], within: list[str]):
    """(key, (UᵀU, CᵀC, Σu, Σ‖u‖², rows)) of rows sorted by ``keys`` and ``within``: the Grams of each chunk ``within``, added up."""
    now, sums = None, None
    for pdf in batches:
        for key, sub in pdf.groupby([*keys, *within], sort=False, dropna=False):
            key = tuple(None if pd.isna(v) else v for v in key)[:len(keys)]
            if key != now:
                if sums is not None:
                    yield now, sums
                now, sums = key, None
            x = np.stack(sub["_x"].to_numpy()).astype(np.float64)
            u, c = _unit_and_centred(x)
            new = (u.T @ u, c.T @ c, u.sum(axis=0), float(np.sum(u * u)), len(x))
            sums = new if sums is None else tuple(a + b for a, b in zip(sums, new))
    if sums is not None:
        yield now, sums


def _cells(gu: np.ndarray, gc: np.ndarray, s: np.ndarray, tr: float, k: int) -> np.ndarray:
    """A pair of Grams and what goes with it in ``gram_partials``' order."""
    iu = np.triu_indices(len(gu))
    return np.concatenate([gu[iu], gc[iu], s, [tr, float(k)]])


def _sorted_by(rows: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    return rows.select(*keys, *within, "_x").repartition(*keys).sortWithinPartitions(*keys, *within)


def _finished(rows: DataFrame, group_cols: list[str], within: list[str], schema: T.StructType, jitter: float, alpha: float) -> DataFrame:
    """The scores of groups whose Grams are whole in one task: many groups a frame, one pair of Grams at a time."""
    names = [f.name for f in schema.fields]

    def run(batches):
        out = []
        for key, (gu, gc, s, tr, k) in _grams(batches, group_cols, within):
            out.append({**dict(zip(group_cols, key)), **_summary(k, gu, gc, s, tr, jitter, alpha)})
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return _sorted_by(rows, group_cols, within).mapInPandas(run, schema)


def _part_cells(rows: DataFrame, group_cols: list[str]) -> DataFrame:
    """(group…, _cell, _v): the cells of ``gram_partials``, once for each part of a group."""
    keys = [*group_cols, "salt"]

    def run(batches):
        for key, sums in _grams(batches, keys, []):
            vals = _cells(*sums)
            out = pd.DataFrame({"_cell": np.arange(len(vals), dtype=np.int32), "_v": vals})
            for c, v in zip(group_cols, key):
                out[c] = v
            yield out[[*group_cols, "_cell", "_v"]]

    schema = T.StructType([rows.schema[c] for c in group_cols] + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_v", T.DoubleType())])
    return _sorted_by(rows, keys, []).mapInPandas(run, schema)


TILE = 1024


def _chunk_tiles(rows: DataFrame, group_cols: list[str]) -> DataFrame:
    """(group…, part, tile, x, n, salt): the cells of ``gram_partials`` of each part of a group, added up over its chunks ``salt`` and cut
    into tiles."""
    keys = [*group_cols, "part"]

    def run(batches):
        for key, sums in _grams(batches, keys, ["salt"]):
            flat = _cells(*sums)
            flat = np.pad(flat, (0, -len(flat) % TILE))
            cut = [flat[i: i + TILE] for i in range(0, len(flat), TILE)]
            for at in range(0, len(cut), 256):
                out = pd.DataFrame({"tile": np.arange(at, min(at + 256, len(cut)), dtype=np.int32), "x": cut[at: at + 256], "n": 1})
                for c, v in zip(keys, key):
                    out[c] = v
                yield out[[*keys, "tile", "x", "n"]]

    schema = T.StructType([rows.schema[c] for c in keys] + [
        T.StructField("tile", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    return _sorted_by(rows, keys, ["salt"]).mapInPandas(run, schema)


def _direct(data: DataFrame, group_cols: list[str], out_schema: T.StructType,
            jitter: float, alpha: float) -> DataFrame:
    """Small groups: hash-partition by group, sort within partitions, and score many
    groups per Arrow batch (a group cut by a batch boundary is carried to the next
    batch). Groups of equal size K are scored together with stacked eigen-solvers, so
    the per-group cost is a slice, not a pandas round trip."""
    from .grouped import map_sorted_groups

    names = [f.name for f in out_schema.fields]
    return map_sorted_groups(data, group_cols, lambda done: _score_sorted_groups(done, group_cols, names, jitter, alpha),
                             out_schema)


def _score_sorted_groups(pdf: pd.DataFrame, group_cols: list[str], names: list[str],
                         jitter: float, alpha: float) -> pd.DataFrame:
    """Score contiguous groups of a sorted frame, batching groups of equal size."""
    codes = pdf.groupby(group_cols, sort=False, dropna=False).ngroup().to_numpy()
    sizes = np.bincount(codes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x_all = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
    d = x_all.shape[1]
    out = {n: np.empty(len(sizes), dtype=object) for n in names}
    keys = pdf.iloc[starts][group_cols].reset_index(drop=True)
    for k in np.unique(sizes):
        gi = np.nonzero(sizes == k)[0]
        rows = (starts[gi][:, None] + np.arange(k)[None, :]).reshape(-1)
        x = x_all[rows].reshape(len(gi), k, d)
        u = x / np.linalg.norm(x, axis=2, keepdims=True)
        c = x - x.mean(axis=2, keepdims=True)
        if k <= d:
            gu, gc = u @ u.transpose(0, 2, 1), c @ c.transpose(0, 2, 1)
        else:
            gu, gc = u.transpose(0, 2, 1) @ u, c.transpose(0, 2, 1) @ c
        lam = _top_eigs_batched(gu, k)
        p = (lam + jitter) / k
        p = np.where(p == 0, ENTROPY_FLOOR, p)
        disp = -np.sum(p * np.log(p), axis=1)
        mu = _top_eigs_batched(gc, k)
        es = np.sum(np.log(mu + alpha), axis=1) / k
        fro2 = np.sum(gu * gu, axis=(1, 2))
        ssum = u.sum(axis=1)
        tr = np.sum(u * u, axis=(1, 2))
        purity = fro2 / (k * k)
        vals = {
            "k": np.full(len(gi), k, dtype=np.int64),
            "dispersion": disp,
            "dispersion_norm": disp / np.log(k) if k > 1 else [None] * len(gi),
            "eigenscore": es, "trace": tr, "fro2": fro2,
            "mean_cos": (np.sum(ssum * ssum, axis=1) - tr) / (k * (k - 1)) if k > 1 else [None] * len(gi),
            "purity": purity, "renyi2": -np.log(purity),
        }
        for n, v in vals.items():
            out[n][gi] = list(v)
    res = pd.DataFrame({n: out[n] for n in names if n not in group_cols})
    for g in group_cols:
        res[g] = keys[g].to_numpy()
    res["k"] = res["k"].astype(np.int64)
    for n in names:
        if n not in group_cols and n != "k":
            res[n] = pd.to_numeric(res[n], errors="coerce")
    return res[names]


def _top_eigs_batched(gram: np.ndarray, k: int) -> np.ndarray:
    ev = np.clip(np.linalg.eigvalsh(gram)[:, ::-1], 0.0, None)
    if ev.shape[1] >= k:
        return ev[:, :k]
    return np.concatenate([ev, np.zeros((ev.shape[0], k - ev.shape[1]))], axis=1)


def gram_partials(data: DataFrame, group_cols: list[str]) -> DataFrame:
    """Partial sums per (input partition, group) in long form ``(group…, _cell, _v)``.

    Cells: upper triangles of UᵀU and CᵀC (unit rows U, row-centred raw rows C),
    then Σu, Σ‖u‖² and the row count. Every cell is additive, so partials of any
    split of a group – partitions, micro-batches – sum to the group's totals.
    ``data`` carries the group columns and ``_x`` (array<double>).
    """
    gfields = [data.schema[g] for g in group_cols]
    part_schema = T.StructType(list(gfields) + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_v", T.DoubleType())])

    def rows(acc: dict):
        for key, vals in acc.items():
            out = pd.DataFrame({"_cell": np.arange(len(vals), dtype=np.int32), "_v": vals})
            for g, kv in zip(group_cols, key):
                out[g] = kv
            yield out[group_cols + ["_cell", "_v"]]

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            if acc and len(acc) * next(iter(acc.values())).nbytes > HELD_BYTES:  # sums so far go out: partials of any split add up
                yield from rows(acc)
                acc = {}
            for key, sub in pdf.groupby(group_cols, sort=False, dropna=False):
                x = np.stack(sub["_x"].to_numpy()).astype(np.float64)
                u, c = _unit_and_centred(x)
                iu = np.triu_indices(x.shape[1])
                vals = np.concatenate([(u.T @ u)[iu], (c.T @ c)[iu], u.sum(axis=0),
                                       [float(np.sum(u * u)), float(len(x))]])
                key = key if isinstance(key, tuple) else (key,)
                if key in acc:
                    acc[key] += vals
                else:
                    acc[key] = vals
        yield from rows(acc)

    return data.mapInPandas(partial, schema=part_schema)


def sum_cells(cells: DataFrame, group_cols: list[str]) -> DataFrame:
    """Native aggregation of partial cells (map-side partial aggregation applies)."""
    return cells.groupBy(*group_cols, "_cell").agg(F.sum("_v").alias("_v"))


def _summary_of_cells(vals: np.ndarray, jitter: float, alpha: float) -> dict:
    """A group's scores from its summed cells in ``gram_partials``' order."""
    d = int(round(np.sqrt(len(vals) - 1))) - 1      # len = d² + 2d + 2
    t = d * (d + 1) // 2
    iu = np.triu_indices(d)

    def sym(flat):
        m = np.zeros((d, d))
        m[iu] = flat
        return m + np.triu(m, 1).T

    s = vals[2 * t:2 * t + d]
    return _summary(int(round(vals[2 * t + d + 1])), sym(vals[:t]), sym(vals[t:2 * t]), s, vals[2 * t + d], jitter, alpha)


def spectra_from_cells(cells: DataFrame, group_cols: list[str], jitter: float = JITTER,
                       alpha: float = EIGENSCORE_ALPHA) -> DataFrame:
    """Finish per group from summed cells: one d×d eigen-problem per Gram (d² rows per group)."""
    gfields = [cells.schema[g] for g in group_cols]
    out_schema = _summary_schema(gfields)
    names = [f.name for f in out_schema.fields]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {g: pdf[g].iloc[0] for g in group_cols}
        row.update(_summary_of_cells(pdf.sort_values("_cell")["_v"].to_numpy(), jitter, alpha))
        return pd.DataFrame([row], columns=names)

    return by_group(cells, group_cols).groupBy(*group_cols).applyInPandas(finish, schema=out_schema)


# ---------------------------------------------------------------- F2 (inspection only)

def cosine_kernel(vectors: DataFrame, group_cols: list[str], item_col: str, vec_col: str) -> DataFrame:
    """the K×K cosine kernel of each group as an upper-triangle entry table.

    Its size is ΣK² by definition, so it is meant for inspecting chosen groups
    (filter first); the scores above never need it.
    """
    u = vectors.select(*group_cols, item_col, unit_vector(F.col(vec_col)).alias("u"))
    a, b = u.alias("a"), u.alias("b")
    cond = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group_cols] + [F.col(f"a.{item_col}") <= F.col(f"b.{item_col}")]
    return a.join(b, cond).select(*[F.col(f"a.{g}").alias(g) for g in group_cols],
                                  F.col(f"a.{item_col}").alias("i"), F.col(f"b.{item_col}").alias("j"),
                                  dot(F.col("a.u"), F.col("b.u")).alias("cos"))


# ---------------------------------------------------------------- F8 pooling

def pool_tokens(tokens: DataFrame, key_cols: list[str], pos_col: str, vec_col: str,
                mask_col: str | None = None, method: str = "mean") -> DataFrame:
    """F8: pool a token-vector table ``(key…, pos, vec[, mask])`` into one vector per key.

    mean is mask-aware (padding excluded); max is element-wise; cls takes the
    first real token, last the last real token (padding side does not matter
    because positions are explicit). Vectors of one table are equally long and without null components; null
    vectors are left out. mean and max add vectors up in Arrow batches: a row per task and key is shuffled,
    never one per dimension.
    """
    t = tokens
    if mask_col is not None:
        t = t.filter(F.col(mask_col) == 1)
    if method in ("cls", "first"):
        return t.groupBy(*key_cols).agg(F.min_by(vec_col, pos_col).alias("pooled"))
    if method == "last":
        return t.groupBy(*key_cols).agg(F.max_by(vec_col, pos_col).alias("pooled"))
    if method not in ("mean", "max"):
        raise ValueError(f"pooling must be mean, max, cls, first or last, not {method!r}")
    # partial vectors per key: one per input partition and key, then one per key and salt, then one per key
    x = F.col(vec_col).cast("array<double>")
    t = t.filter(F.col(vec_col).isNotNull()).select(*key_cols, x.alias("x"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("salt"))
    part = _merged(_combined(t, key_cols, method, sort=False), key_cols, method)
    mean = F.transform("x", lambda v: v / F.col("n")) if method == "mean" else F.col("x")
    return part.select(*key_cols, mean.alias("pooled"))


POOL_SALTS = 32
POOL_BYTES = 64 << 20   # partial vectors that a task holds before it hands them on


def _merged(partial: DataFrame, key_cols: list[str], method: str) -> DataFrame:
    """One row per key of partial vectors, however many a key has: merged per key and salt, then per key."""
    part = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(POOL_SALTS)))
    for salt in (F.col("salt"), F.lit(0)):
        keys = [*key_cols, "salt"]
        part = _combined(part.withColumn("salt", salt).repartition(*keys).sortWithinPartitions(*keys), key_cols, method, sort=True)
    return part


def _combined(rows: DataFrame, key_cols: list[str], method: str, sort: bool) -> DataFrame:
    """(key…, x, n, salt) with the vectors of one key added up (or their maxima) within a task: for sorted rows one row per key
    and salt, else one whenever the task holds too many."""
    keys = [*key_cols, "salt"]
    add = np.add if method == "mean" else np.fmax

    def run(batches):
        held: dict = {}
        width = 1

        def out(which: list) -> pd.DataFrame:
            frame = pd.DataFrame([k for k in which], columns=keys).astype(object)
            frame["x"], frame["n"] = [held[k][0] for k in which], [held[k][1] for k in which]
            for k in which:
                del held[k]
            return frame[[*keys, "x", "n"]]

        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            width = x.shape[1]
            codes, first = pd.factorize(pd.MultiIndex.from_frame(pdf[keys].astype(object).where(pdf[keys].notna(), None)), sort=False)
            order = np.argsort(codes, kind="stable")
            begin = np.searchsorted(codes[order], np.arange(len(first)))
            sums, counts = add.reduceat(x[order], begin, axis=0), np.add.reduceat(pdf["n"].to_numpy()[order], begin)
            for key, s, n in zip(first.tolist(), sums, counts.tolist()):
                key = tuple(None if pd.isna(v) else v for v in key)
                old = held.get(key)
                held[key] = (s, n) if old is None else (add(old[0], s), old[1] + n)
            last = key
            if sort and len(held) > 1:
                yield out([k for k in held if k != last])
            elif len(held) * width * 8 > POOL_BYTES:
                yield out(list(held))
        if held:
            yield out(list(held))

    schema = T.StructType([rows.schema[c] for c in keys] + [rows.schema["x"], rows.schema["n"]])
    return rows.select(*keys, "x", "n").mapInPandas(run, schema)
