"""Parameter grids, model specs and the truncation-length sweep.

A sweep is one Spark job: statements are exploded against the grid's lengths,
truncated per (response, length), embedded, and scored per (group, length) –
no per-cell child process and no per-cell re-read of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import embed as EM
from ..session import cut_lineage
from . import statements as ST
from . import vectors as V


def parameter_grid(runs: DataFrame, list_cols: list[str]) -> DataFrame:
    """Cartesian grid per run block – one ``explode`` per list column (no cross join); a
    scalar column counts as a list of one."""
    g = runs
    for c in list_cols:
        one_of = isinstance(g.schema[c].dataType, T.ArrayType)
        g = g.withColumn(c, F.explode(g[c] if one_of else F.array(g[c])))
    return g


def model_spec(spec: Column) -> Column:
    """Model spec ``array<string>`` of 3, 2 or 1 elements → struct(name, pooling, suffix);
    a string is a spec with the name only (``spec_list`` makes it one).

    Suffix = last path part of the name with '-' → '_' unless given; pooling
    defaults to 'mean'."""
    name = F.element_at(spec, 1)
    pooling = F.when(F.size(spec) >= 2, F.element_at(spec, 2)).otherwise(F.lit("mean"))
    derived = F.replace(F.substring_index(name, "/", -1), F.lit("-"), F.lit("_"))
    suffix = F.when(F.size(spec) >= 3, F.element_at(spec, 3)).otherwise(derived)
    return F.struct(name.alias("name"), pooling.alias("pooling"), suffix.alias("suffix"))


def spec_list(df: DataFrame, col: str) -> Column:
    """The spec column as ``array<string>``, whether it holds strings or lists."""
    return F.col(col) if isinstance(df.schema[col].dataType, T.ArrayType) else F.array(F.col(col))


def truncation_sweep(stmts: DataFrame, key_cols: list[str], lengths: list[int]) -> DataFrame:
    """F12 + D12 + D13: every response truncated at every length in one pass.

    Returns ``key…, response_count, n_kept, truncated``.
    """
    # the words before a statement do not depend on the length: one window, then the lengths
    keys = key_cols + ["response_count"]
    kept = _kept_at(ST.words_before(stmts, key_cols), lengths)
    all_keys = stmts.select(*key_cols).distinct().withColumn(
        "response_count", F.explode(F.array(*[F.lit(n) for n in lengths])))
    return ST.rebuild_text(kept, keys, all_keys=all_keys)


def additive_sweep_embeddings(stmts: DataFrame, key_cols: list[str], lengths: list[int],
                              embed=EM.hashed_embedding, dim: int = EM.DIM) -> DataFrame:
    """Embeddings of every truncated response for an embedder that is additive over
    statements (token counts): each statement is embedded once, and a truncated response's
    vector is the sum of its kept statements' vectors – no re-embedding per length."""
    keys = key_cols + ["response_count"]
    kept = _kept_at(ST.words_before(stmts, key_cols).withColumn("_v", embed(F.col("text"))), lengths)
    # sums by element (map-side partial sums): no response's vectors are collected
    return kept.groupBy(*keys).agg(F.array(*[F.sum(F.get("_v", F.lit(i))) for i in range(dim)]).alias("vec"))


def _kept_at(stmts: DataFrame, lengths: list[int]) -> DataFrame:
    """Statements kept at each length, one row per statement and length that keeps it."""
    all_lengths = F.array(*[F.lit(n) for n in lengths])
    return stmts.withColumn("response_count", F.explode(F.filter(all_lengths, lambda n: F.col("_words_before") < n))).drop("_words_before")


def dispersion_sweep(stmts: DataFrame, group_cols: list[str], resp_col: str, lengths: list[int],
                     embed=EM.hashed_embedding, additive: bool | None = None) -> DataFrame:
    """F11 + F12: dispersion per (group, response_count) of the embedded truncated responses.

    ``additive`` (default: True for the hashed-token embedder) embeds statements once
    and sums; otherwise every truncated text is embedded as a whole.
    """
    if additive is None:
        additive = embed is EM.hashed_embedding
    if additive:
        e = additive_sweep_embeddings(stmts, group_cols + [resp_col], lengths, embed)
    else:
        t = truncation_sweep(stmts, group_cols + [resp_col], lengths)
        e = t.select(*group_cols, resp_col, "response_count", embed(F.col("truncated")).alias("vec"))
    good, _ = V.normalize_rows(e, "vec")
    # The embedded sweep feeds two passes (group sizes, then scores): write it once.
    good = cut_lineage(good.select(*group_cols, "response_count", "vec"))
    return V.group_spectra(good, group_cols + ["response_count"], "vec")
