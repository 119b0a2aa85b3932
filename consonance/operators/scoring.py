"""Scoring of a group table by metric name, from texts to the long metrics form.

``responses``: group…, response_idx, response (and ``entity`` for the embedding header). Every metric
returns ``group…, metric, name, item, value``: ``item`` is null for a value of the whole group, the
response index or claim index for a value of one of its members.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embed as EM
from ..session import cut_lineage
from ..sources.snapshots import SnapshotTable
from . import claims as H
from . import entailment as G
from . import prep as P
from . import statements as ST
from . import sweep as S
from . import vectors as V

METRICS = ("dispersion", "luq", "entailment", "graph_uncertainty")


def _long(df: DataFrame, group_cols: list[str], metric: str, values: dict[str, Column], item: Column | None = None) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()]))
    item = F.lit(None) if item is None else item
    return df.select(*group_cols, F.lit(metric).alias("metric"), item.cast("long").alias("item"), rows.alias("m")).select(
        *group_cols, "metric", "m.name", "item", "m.value")


def prepared(responses: DataFrame, group_cols: list[str], response_count: int | None = None, subset: int | None = None,
             seed: int = 0) -> DataFrame:
    """The responses to score: ``subset`` of each group's (B20, all if it has fewer), truncated to
    ``response_count`` words at statement ends (D12, D13)."""
    r = responses
    if subset is not None:
        chosen = P.group_subset(r.select(*group_cols, "response_idx"), group_cols, "response_idx", subset, seed)
        r = r.join(chosen, [*group_cols, "response_idx"], "left_semi")
    if response_count is not None:
        keys = [*group_cols, "response_idx"]
        short = S.truncation_sweep(ST.split_statements(r, keys), keys, [response_count]).select(*keys, "truncated")
        r = r.join(short, keys, "left").withColumn("response", F.coalesce("truncated", F.lit("."))).drop("truncated")
    return r


def embedded(responses: DataFrame, group_cols: list[str], embed=EM.hashed_embedding, model_name: str = "") -> DataFrame:
    """``group…, response_idx, vec`` of each response under its embedding header (B6); the vectors
    are an output of their own."""
    text = P.embed_header(F.col("entity"), F.col("response"), model_name) if "entity" in responses.columns else F.col("response")
    return responses.select(*group_cols, "response_idx", embed(text).alias("vec"))


def entailment_tables(responses: DataFrame, group_cols: list[str], scorer=G.default_scorer) -> dict[str, DataFrame]:
    """All entailment outputs of a group table, each pair scored once: ``pairs``, ``ids``
    (clusters), ``laplacian`` and ``metrics`` (long form)."""
    g = group_cols
    unordered = cut_lineage(G.nli_pairs_unordered(responses, g, scorer=scorer))
    pairs, items = G.ordered_pairs(unordered, g), responses.select(*g, F.col("response_idx").alias("i"))
    ids = cut_lineage(G.semantic_ids(unordered, items, g))
    edges = G.entailment_graph(unordered, g, weighted=True)
    _s, u = G.selfcheck(pairs, items, g)
    values = _long(G.cluster_entropy(ids, g), g, "entailment", {"semantic_entropy": F.col("entropy"), "n_clusters": F.col("n_clusters")})
    values = values.unionByName(_long(G.degree_uncertainty(pairs, items, g), g, "entailment", {"u_deg": F.col("u_deg")}))
    values = values.unionByName(_long(u, g, "entailment", {"u_nli": F.col("u_nli")}))
    panel = G.spectral_panel(pairs, items, g).select(*g, F.lit("entailment").alias("metric"), F.col("metric").alias("name"),
                                                      F.lit(None).cast("long").alias("item"), "value")
    return {"pairs": pairs, "ids": ids, "laplacian": G.laplacian(edges, items, g), "metrics": values.unionByName(panel)}


def score(metric: str, responses: DataFrame, group_cols: list[str], response_count: int | None = None, subset: int | None = None,
          seed: int = 0, embed=EM.hashed_embedding, model_name: str = "", scorer=None, atoms: DataFrame | None = None) -> DataFrame:
    """A metric by name; unknown names raise. Result: ``group…, metric, name, item, value`` and
    ``subset_idx``, the response indices that were scored."""
    return scores([metric], responses, group_cols, response_count, subset, seed, embed, model_name, scorer, atoms)


def scores(metrics: Sequence[str], responses: DataFrame, group_cols: list[str], response_count: int | None = None, subset: int | None = None,
           seed: int = 0, embed=EM.hashed_embedding, model_name: str = "", scorer=None, atoms: DataFrame | None = None) -> DataFrame:
    """The rows of ``score`` for several metrics, over responses that are chosen and cut once for all of them."""
    for metric in metrics:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}: one of {', '.join(METRICS)}")
    g = group_cols
    # every metric reads the responses several times: choose and cut them once
    r = cut_lineage(prepared(responses, g, response_count, subset, seed))
    out = None
    for metric in metrics:
        part = _values(metric, r, responses, g, subset, embed, model_name, scorer, atoms)
        out = part if out is None else out.unionByName(part)
    chosen = r.groupBy(*g).agg(F.array_sort(F.collect_list(F.col("response_idx").cast("int"))).alias("subset_idx"))
    return out.join(chosen, g, "left")


def _values(metric: str, r: DataFrame, responses: DataFrame, g: list[str], subset: int | None, embed, model_name: str, scorer, atoms: DataFrame | None) -> DataFrame:
    """``group…, metric, name, item, value`` of the prepared responses ``r``."""
    if metric == "dispersion":
        good, _rejected = V.normalize_rows(embedded(r, g, embed, model_name), "vec")
        s = V.group_spectra(good, g, "vec")
        return _long(s, g, metric, {n: F.col(n) for n in ("dispersion", "dispersion_norm", "eigenscore")})
    if metric == "luq":
        conf, unc = G.luq(ST.split_statements(r, [*g, "response_idx"]), r, g, scorer=scorer)
        return _long(unc, g, metric, {"uncertainty": F.col("uncertainty")}).unionByName(
            _long(conf, g, metric, {"confidence": F.col("confidence")}, F.col("response_idx")))
    if metric == "entailment":
        return entailment_tables(r, g, scorer or G.default_scorer)["metrics"]
    own = atoms if atoms is not None else ST.split_statements(r, [*g, "response_idx"]).withColumnRenamed("statement_idx", "atom_idx")
    if subset is not None and atoms is not None:
        own = own.join(r.select(*g, "response_idx"), [*g, "response_idx"], "left_semi")
    m = H.graph_uncertainty(own, responses if atoms is not None else r, g)
    return _long(m, g, metric, {n: F.col(n) for n in ("degree", "betweenness", "eigenvector", "pagerank", "closeness")}, F.col("node_id"))


def score_missing(groups: DataFrame, group_cols: list[str], scorer, store: SnapshotTable, flush_groups: int) -> int:
    """C8 + J1: score the groups that ``store`` (keyed by ``group_cols``) lacks, and add them in flushes of about
    ``flush_groups`` groups. ``scorer(rows of some groups)`` gives rows with the group columns; a group it gives
    none for is tried again by the next call. Each flush is one version of the store: a call that stops half way leaves
    whole flushes behind, and the next one goes on with the rest. Only keys of the store are read. Returns the number of flushes.
    """
    keys = groups.select(*group_cols).distinct()
    done = store.read()
    if done is not None:
        keys = P.drop_done(keys, done.select(*group_cols).distinct(), group_cols)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in group_cols]), F.lit(1 << 20))
    missing = cut_lineage(keys.withColumn("_part", part))
    flushes = -(-missing.count() // flush_groups)
    for i in range(flushes):
        own = missing.filter(F.pmod("_part", F.lit(flushes)) == i).drop("_part")
        if not own.isEmpty():
            store.append(scorer(groups.join(own, group_cols, "left_semi")))
    return flushes
