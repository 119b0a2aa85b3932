"""Entailment-based uncertainty over response groups (G family, LUQ).

The entailment tensor of a group is a pair table
``(group…, i, j, p_contra, p_neutral, p_entail)`` for i ≠ j (the diagonal is
implied: entail = 1). It is produced by *one* self-join per unordered pair
(i < j) that scores both directions in the same row, so the transpose never
needs a second join. Its ΣK(K−1) size is the definition of these metrics
(K = sampled responses per question); the join keys on the group, and AQE's
skew-join splitting spreads a hot group over many tasks.

Scorers are Column functions ``scorer(premise_tokens, hypothesis_tokens,
premise_text, hypothesis_text) -> struct(p_contra, p_neutral, p_entail)``;
the default is the lexical stand-in of ``functions.text.nli_probs``. A
model-backed scorer is a ``pandas_udf`` / ``predict_batch_udf`` with the same
signature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import cut_lineage


# Fixed values of the kernel panel and thresholds (names must match the original metric keys).
HEAT_NAME = "{kind}_t={t:.2}"                        # kind: heat (plain L), heatn (normalised L)
MATERN_NAME = "{kind}_kappa={kappa:.2}_nu={nu:.2}"   # kind: matern, maternn
ENTROPY_SUFFIX = "_kernel_entropy"
SCALED_SUFFIX = "_s"
WEIGHTED_PREFIX = "weighted_"
HEAT_T = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
MATERN_KAPPA = [1.0, 2.0, 3.0]
MATERN_NU = [1.0, 2.0, 3.0]
EDGE_THRESHOLD = 1.5
EIG_FLOOR = 1e-8
KERNEL_EPS = 1e-12
ECC_PCT = 0.5
LOGSUMEXP_SUM_OFFSET = -5.0


def default_scorer(p_tok: Column, h_tok: Column, p_txt: Column | None = None, h_txt: Column | None = None) -> Column:
    return TX.nli_probs(TX.containment(p_tok, h_tok))


def two_class_probs(p_entail: Column, p_not: Column) -> Column:
    """G1 for models with two classes: what the two leave of 1 counts as neutral."""
    return F.struct(p_not.alias("p_contra"), (1.0 - (p_entail + p_not)).alias("p_neutral"), p_entail.alias("p_entail"))


# ---------------------------------------------------------------- G1 pair table

def _tokenised(responses: DataFrame, group_cols: list[str], idx_col: str, text_col: str) -> DataFrame:
    return responses.select(*group_cols, F.col(idx_col).alias("_i"), F.col(text_col).alias("_txt"),
                            F.array_distinct(TX.tokens(F.col(text_col))).alias("_tok"))


PROBS = ("p_contra", "p_neutral", "p_entail")


def nli_pairs_unordered(responses: DataFrame, group_cols: list[str], idx_col: str = "response_idx",
                        text_col: str = "response", scorer=default_scorer) -> DataFrame:
    """G1 in unordered form: one row per pair i < j with both directions,
    ``p_*_ij`` (premise i) and ``p_*_ji`` (premise j). Operators that need both
    directions (G6, G7, G13, G14, G16) use it without a transpose join."""
    t = _tokenised(responses, group_cols, idx_col, text_col)
    a, b = t.alias("a"), t.alias("b")
    cond = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group_cols] + [F.col("a._i") < F.col("b._i")]
    keys = [*[F.col(f"a.{g}").alias(g) for g in group_cols], F.col("a._i").alias("i"), F.col("b._i").alias("j")]
    if scorer is default_scorer:
        # Containment once per direction, behind a one-row ``inline`` (a Generate node):
        # later filters on the probabilities (equivalence, edge thresholds) are then not
        # pushed into the join condition with the containment expression copied into
        # every reference.
        j = a.join(b, cond).select(*keys, F.inline(F.array(F.struct(
            TX.containment(F.col("a._tok"), F.col("b._tok")).alias("_c_ij"),
            TX.containment(F.col("b._tok"), F.col("a._tok")).alias("_c_ji")))))
        fw, bw = TX.nli_probs(F.col("_c_ij")), TX.nli_probs(F.col("_c_ji"))
    else:
        j = a.join(b, cond).select(
            *keys, scorer(F.col("a._tok"), F.col("b._tok"), F.col("a._txt"), F.col("b._txt")).alias("_fw"),
            scorer(F.col("b._tok"), F.col("a._tok"), F.col("b._txt"), F.col("a._txt")).alias("_bw"))
        fw, bw = F.col("_fw"), F.col("_bw")
    return j.select(*group_cols, "i", "j", *[fw[p].alias(f"{p}_ij") for p in PROBS],
                    *[bw[p].alias(f"{p}_ji") for p in PROBS])


def nli_pairs(responses: DataFrame, group_cols: list[str], idx_col: str = "response_idx",
              text_col: str = "response", scorer=default_scorer) -> DataFrame:
    """G1: 3-way probabilities for every ordered pair i ≠ j of a group."""
    return ordered_pairs(nli_pairs_unordered(responses, group_cols, idx_col, text_col, scorer), group_cols)


def ordered_pairs(unordered: DataFrame, group_cols: list[str]) -> DataFrame:
    """Unordered two-direction rows → ordered pair table (one explode, no shuffle)."""
    j = unordered.select(*group_cols, "i", "j",
                         F.struct(*[F.col(f"{p}_ij").alias(p) for p in PROBS]).alias("fw"),
                         F.struct(*[F.col(f"{p}_ji").alias(p) for p in PROBS]).alias("bw"))
    both = F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("fw").alias("p")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("bw").alias("p"))))
    return j.select(*group_cols, both.alias("e")).select(
        *group_cols, F.col("e.i").alias("i"), F.col("e.j").alias("j"),
        F.col("e.p.p_contra").alias("p_contra"), F.col("e.p.p_neutral").alias("p_neutral"),
        F.col("e.p.p_entail").alias("p_entail"))


def implication(pairs: DataFrame) -> DataFrame:
    """Argmax label (0 contradiction, 1 neutral, 2 entailment; ties → lowest) and confidence."""
    c, n, e = F.col("p_contra"), F.col("p_neutral"), F.col("p_entail")
    label = F.when((c >= n) & (c >= e), 0).when(n >= e, 1).otherwise(2)
    return pairs.withColumn("label", label.cast("int")).withColumn("confidence", F.greatest(c, n, e))


def _label(c, n, e):
    return F.when((c >= n) & (c >= e), 0).when(n >= e, 1).otherwise(2).cast("int")


def _unordered(pairs: DataFrame, group_cols: list[str]) -> DataFrame:
    """Both directions of each unordered pair in one row (i < j): labels and confidences.

    Accepts the unordered form (no join needed) or an ordered pair table (joined to
    its transpose)."""
    if "p_entail_ji" in pairs.columns:
        cols = {d: [F.col(f"{p}_{d}") for p in PROBS] for d in ("ij", "ji")}
        return pairs.select(*group_cols, "i", "j", _label(*cols["ij"]).alias("l_ij"), F.greatest(*cols["ij"]).alias("c_ij"),
                            _label(*cols["ji"]).alias("l_ji"), F.greatest(*cols["ji"]).alias("c_ji"))
    imp = implication(pairs)
    fw = imp.filter(F.col("i") < F.col("j")).select(*group_cols, "i", "j", F.col("label").alias("l_ij"),
                                                    F.col("confidence").alias("c_ij"))
    bw = imp.filter(F.col("i") > F.col("j")).select(*group_cols, F.col("j").alias("i"), F.col("i").alias("j"),
                                                    F.col("label").alias("l_ji"), F.col("confidence").alias("c_ji"))
    return fw.join(bw, group_cols + ["i", "j"])


def equivalence(pairs: DataFrame, group_cols: list[str], strict: bool = False) -> DataFrame:
    """Two-way equivalence of each unordered pair (i < j), in both forms; ``strict`` says
    which one ``equivalent`` holds."""
    u = _unordered(pairs, group_cols)
    l1, l2 = F.col("l_ij"), F.col("l_ji")
    both, default = (l1 == 2) & (l2 == 2), (l1 != 0) & (l2 != 0) & ~((l1 == 1) & (l2 == 1))
    return u.withColumn("equivalent", both if strict else default).withColumn("equivalent_strict", both)


# ---------------------------------------------------------------- G7 clusters

def semantic_ids(pairs: DataFrame, items: DataFrame, group_cols: list[str], idx_col: str = "i",
                 strict: bool = False) -> DataFrame:
    """Order-dependent greedy clustering, as a native fold per group.

    Item i is a head when no earlier head is equivalent to it; otherwise it
    takes the id of the *latest* earlier equivalent head (later heads
    overwrite). Ids are dense in head order. ``items`` lists every item
    ``(group…, i)`` so singletons without pairs are kept.
    """
    eq = equivalence(pairs, group_cols, strict).filter("equivalent")
    adj = eq.groupBy(*group_cols, F.col("j").alias("i")).agg(F.collect_list("i").alias("adj"))
    it = items.select(*group_cols, F.col(idx_col).cast("long").alias("i")).join(adj, group_cols + ["i"], "left")
    seq = it.groupBy(*group_cols).agg(F.array_sort(F.collect_list(
        F.struct(F.col("i"), F.coalesce(F.col("adj"), F.array().cast("array<long>")).cast("array<long>").alias("adj")))).alias("seq"))
    init = F.struct(F.array().cast("array<long>").alias("heads"),
                    F.array().cast("array<struct<i:bigint,cid:int>>").alias("out"))

    def step(acc, x):
        common = F.array_intersect(acc["heads"], x["adj"])
        new = F.size(common) == 0
        cid = F.when(new, F.size(acc["heads"])).otherwise(
            (F.array_position(acc["heads"], F.array_max(common)) - 1).cast("int"))
        heads = F.when(new, F.concat(acc["heads"], F.array(x["i"]))).otherwise(acc["heads"])
        return F.struct(heads.alias("heads"),
                        F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), cid.cast("int").alias("cid")))).alias("out"))

    folded = seq.select(*group_cols, F.aggregate("seq", init, step)["out"].alias("out"))
    return folded.select(*group_cols, F.explode("out").alias("o")).select(
        *group_cols, F.col("o.i").alias("i"), F.col("o.cid").alias("cluster_id"))


def semantic_ids_rounds(pairs: DataFrame, items: DataFrame, group_cols: list[str], idx_col: str = "i", strict: bool = False) -> DataFrame:
    """G7 for groups of any size: the clusters of ``semantic_ids`` by rounds of joins on the equivalent pairs.

    Heads are the lexicographically first independent set. In a round, every undecided item with no undecided
    earlier equivalent becomes a head, and the later equivalents of heads are decided with it; pairs of decided
    items leave the table. Random orders take about log² n rounds (a chain of equivalents in index order takes half its length).
    No row holds more than one pair.
    """
    from .prep import number_within_groups

    g = group_cols
    eq = cut_lineage(equivalence(pairs, g, strict).filter("equivalent").select(*g, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    open_ = cut_lineage(items.select(*g, F.col(idx_col).cast("long").alias("i")))
    edges, heads = eq, None
    while not open_.isEmpty():
        new = cut_lineage(open_.join(edges.select(*g, F.col("j").alias("i")).distinct(), [*g, "i"], "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        taken = edges.join(new, [*g, "i"], "left_semi").select(*g, F.col("j").alias("i")).distinct()
        open_ = cut_lineage(open_.join(new.unionByName(taken), [*g, "i"], "left_anti"))
        edges = cut_lineage(edges.join(open_, [*g, "i"], "left_semi").join(open_.withColumnRenamed("i", "j"), [*g, "j"], "left_semi"))
    if heads is None:
        return items.select(*g, F.col(idx_col).cast("long").alias("i"), F.lit(0).alias("cluster_id"))
    named = cut_lineage(number_within_groups(heads, g, ["i"], "cluster_id").select(*g, "i", F.col("cluster_id").cast("int").alias("cluster_id")))
    own = eq.join(named, [*g, "i"]).groupBy(*g, F.col("j").alias("i")).agg(F.max_by("cluster_id", "i").alias("cluster_id"))
    return named.unionByName(own.select(*g, "i", "cluster_id"))


def cluster_entropy(ids: DataFrame, group_cols: list[str], cid_col: str = "cluster_id") -> DataFrame:
    """−Σ p ln p over cluster frequencies."""
    counts = ids.groupBy(*group_cols, cid_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols)
    p = counts.withColumn("_p", F.col("_n") / F.sum("_n").over(w))
    return p.groupBy(*group_cols).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"),
                                      F.count(F.lit(1)).alias("n_clusters"))


def logsumexp_by_cluster(df: DataFrame, group_cols: list[str], cid_col: str, ll_col: str,
                         agg: str = "sum", offset: float = LOGSUMEXP_SUM_OFFSET) -> DataFrame:
    """Per (group, cluster) log-sum-exp of log-likelihoods, max-shifted.

    modes: ``sum`` (plus a constant ``offset``, −5.0 by default), ``sum_normalized``
    (minus the group's log-sum-exp), ``mean`` (minus ln n).
    """
    if agg not in ("sum", "sum_normalized", "mean"):
        raise ValueError(f"unknown aggregation {agg!r}")
    k = [*group_cols, cid_col]
    top = df.groupBy(*k).agg(F.max(ll_col).alias("_m"))
    per = df.join(top, k).groupBy(*k).agg(F.first("_m").alias("_m"), F.count(F.lit(1)).alias("_n"),
                                          F.sum(F.exp(F.col(ll_col) - F.col("_m"))).alias("_s"))
    per = per.withColumn("_lse", F.log("_s") + F.col("_m"))
    if agg == "sum":
        out = per.withColumn("value", F.col("_lse") + F.lit(offset))
    elif agg == "mean":
        out = per.withColumn("value", F.col("_lse") - F.log(F.col("_n").cast("double")))
    else:
        w = Window.partitionBy(*group_cols)
        gm = F.max("_m").over(w)
        total = F.log(F.sum(F.exp(F.col("_lse") - gm)).over(w)) + gm
        out = per.withColumn("value", F.col("_lse") - total)
    return out.select(*group_cols, cid_col, "value")


# ---------------------------------------------------------------- G9 / G12 (native)

def degree_uncertainty(pairs: DataFrame, items: DataFrame, group_cols: list[str]) -> DataFrame:
    """U_deg = 1 − ΣW/m² with W = (E+Eᵀ)/2 including the unit diagonal."""
    m = items.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("m"))
    s = pairs.groupBy(*group_cols).agg(F.sum("p_entail").alias("_s"))
    j = m.join(s, group_cols, "left").fillna({"_s": 0.0})
    return j.select(*group_cols, "m", (1 - (F.col("m") + F.col("_s")) / (F.col("m") * F.col("m"))).alias("u_deg"))


def selfcheck(pairs: DataFrame, items: DataFrame, group_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """p = e^c/(e^c+e^e) on probabilities; S_i = row mean incl. diagonal; U = mean(1−S)."""
    diag = 1.0 / (1.0 + math.e)
    p = pairs.withColumn("_p", F.exp("p_contra") / (F.exp("p_contra") + F.exp("p_entail")))
    row = p.groupBy(*group_cols, "i").agg(F.sum("_p").alias("_s"))
    m = items.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("m"))
    it = items.select(*group_cols, F.col("i")).join(m, group_cols).join(row, group_cols + ["i"], "left")
    s = it.select(*group_cols, "i", ((F.coalesce("_s", F.lit(0.0)) + diag) / F.col("m")).alias("s_nli"))
    u = s.groupBy(*group_cols).agg(F.avg(1 - F.col("s_nli")).alias("u_nli"))
    return s, u


# ---------------------------------------------------------------- G13–G16 (native)

def entailment_graph(pairs: DataFrame, group_cols: list[str], weighted: bool = False,
                     weight_strategy: str = "manual") -> DataFrame:
    """Undirected edges i < j. Weight = [i→j entails] + [j→i entails] + ½ per neutral
    direction. Unweighted: an edge iff weight ≥ 1.5. Weighted: keep weight > 0 (``manual``) or
    use the sum of both max probabilities (``deberta``)."""
    if weight_strategy not in ("manual", "deberta"):
        raise ValueError(f"weight_strategy must be manual or deberta, not {weight_strategy!r}")
    u = _unordered(pairs, group_cols)
    w = ((F.col("l_ij") == 2).cast("double") + (F.col("l_ji") == 2).cast("double")
         + 0.5 * (F.col("l_ij") == 1).cast("double") + 0.5 * (F.col("l_ji") == 1).cast("double"))
    u = u.withColumn("w_manual", w)
    if not weighted:
        return u.filter(F.col("w_manual") >= EDGE_THRESHOLD).select(*group_cols, "i", "j", F.lit(1.0).alias("weight"))
    u = u.filter(F.col("w_manual") > 0)
    weight = F.col("w_manual") if weight_strategy == "manual" else F.col("c_ij") + F.col("c_ji")
    return u.select(*group_cols, "i", "j", weight.alias("weight"))


def entailment_graphs(pairs: DataFrame, group_cols: list[str]) -> DataFrame:
    """G13 in all three forms (``kind``: unweighted, manual, deberta) from one reading of the pairs."""
    u = _unordered(pairs, group_cols)
    w = ((F.col("l_ij") == 2).cast("double") + (F.col("l_ji") == 2).cast("double")
         + 0.5 * (F.col("l_ij") == 1).cast("double") + 0.5 * (F.col("l_ji") == 1).cast("double"))
    u = u.select(*group_cols, "i", "j", w.alias("w"), (F.col("c_ij") + F.col("c_ji")).alias("c"))
    form = lambda kind, weight, keep: F.struct(F.lit(kind).alias("kind"), weight.alias("weight"), keep.alias("keep"))
    forms = F.explode(F.array(form("unweighted", F.lit(1.0), F.col("w") >= EDGE_THRESHOLD),
                              form("manual", F.col("w"), F.col("w") > 0), form("deberta", F.col("c"), F.col("w") > 0)))
    return u.select(*group_cols, "i", "j", forms.alias("f")).filter("f.keep").select(*group_cols, "i", "j", "f.weight", "f.kind")


def cluster_graph(edges: DataFrame, ids: DataFrame, group_cols: list[str]) -> DataFrame:
    """Summed positive weights between clusters (self-loops kept, unordered cluster pair)."""
    ci = ids.select(*group_cols, F.col("i"), F.col("cluster_id").alias("ci"))
    cj = ids.select(*group_cols, F.col("i").alias("j"), F.col("cluster_id").alias("cj"))
    e = edges.join(ci, group_cols + ["i"]).join(cj, group_cols + ["j"])
    return e.groupBy(*group_cols, F.least("ci", "cj").alias("c1"), F.greatest("ci", "cj").alias("c2")).agg(
        F.sum("weight").alias("weight"))


def order_by_cluster(ids: DataFrame, group_cols: list[str]) -> DataFrame:
    """Node order by semantic-id order (then item order)."""
    w = Window.partitionBy(*group_cols).orderBy("cluster_id", "i")
    return ids.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def laplacian(edges: DataFrame, items: DataFrame, group_cols: list[str], normalized: bool = False) -> DataFrame:
    """Laplacian entries ``(group…, i, j, value)``; L = D − A, or D^-½ (D − A) D^-½
    (isolated nodes get a zero row)."""
    both = edges.select(*group_cols, "i", "j", "weight").unionByName(
        edges.select(*group_cols, F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    deg = both.groupBy(*group_cols, "i").agg(F.sum("weight").alias("d"))
    nodes = items.select(*group_cols, "i").join(deg, group_cols + ["i"], "left").fillna({"d": 0.0})
    if not normalized:
        diag = nodes.select(*group_cols, "i", F.col("i").alias("j"), F.col("d").alias("value"))
        off = both.select(*group_cols, "i", "j", (-F.col("weight")).alias("value"))
        return diag.unionByName(off)
    diag = nodes.select(*group_cols, "i", F.col("i").alias("j"),
                        F.when(F.col("d") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"))
    di = deg.select(*group_cols, "i", F.col("d").alias("di"))
    dj = deg.select(*group_cols, F.col("i").alias("j"), F.col("d").alias("dj"))
    off = both.join(di, group_cols + ["i"]).join(dj, group_cols + ["j"]).select(
        *group_cols, "i", "j", (-F.col("weight") / F.sqrt(F.col("di") * F.col("dj"))).alias("value"))
    return diag.unionByName(off)


# ---------------------------------------------------------------- grouped spectral kernels

def _laplacians(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    deg = adj.sum(axis=1)
    plain = np.diag(deg) - adj
    with np.errstate(divide="ignore"):
        dh = 1.0 / np.sqrt(deg)
    dh[~np.isfinite(dh)] = 0.0
    norm = dh[:, None] * plain * dh[None, :]
    return plain, norm


def _kernel_panel(adj: np.ndarray) -> list[tuple[str, float]]:
    """G17 + G18 + G21: 32 kernels (heat, Matérn; plain and normalised Laplacian) × scaled/unscaled.

    All kernels share the two Laplacian eigenbases: they are built with one ``einsum`` per
    family, and their entropies come from one stacked ``eigvalsh`` call."""
    plain, norm = _laplacians(adj)
    names, spectra, bases = [], [], []
    eig = {False: np.linalg.eigh(plain), True: np.linalg.eigh(norm)}
    for t in HEAT_T:
        for normed, name in ((False, "heat"), (True, "heatn")):
            lam, v = eig[normed]
            names.append(HEAT_NAME.format(kind=name, t=t))
            spectra.append(np.exp(-t * lam))
            bases.append(v)
    for kappa in MATERN_KAPPA:
        for nu in MATERN_NU:
            for normed, name in ((False, "matern"), (True, "maternn")):
                lam, v = eig[normed]
                names.append(MATERN_NAME.format(kind=name, kappa=kappa, nu=nu))
                spectra.append(np.power(2 * nu / kappa ** 2 + lam, -nu))
                bases.append(v)
    v = np.stack(bases)
    kernels = np.einsum("kij,kj,klj->kil", v, np.stack(spectra), v)
    out = []
    for name, (scaled, plain_h) in zip(names, _vn_entropies(kernels)):
        out.append((name + ENTROPY_SUFFIX + SCALED_SUFFIX, scaled))
        out.append((name + ENTROPY_SUFFIX, plain_h))
    return out


def _vn_entropies(kernels: np.ndarray) -> list[tuple[float, float]]:
    """G19 + G20 for a stack of kernels: normalise, ÷ n, −Σ e ln e over |e| > 1e-8; (scaled, unscaled)."""
    n = kernels.shape[1]
    d = np.sqrt(np.einsum("kii->ki", kernels)) + KERNEL_EPS
    kn = kernels / (d[:, :, None] * d[:, None, :]) / n
    ev = np.linalg.eigvalsh((kn + kn.transpose(0, 2, 1)) / 2)
    keep = np.abs(ev) > EIG_FLOOR
    with np.errstate(invalid="ignore", divide="ignore"):
        h = -np.sum(np.where(keep, ev * np.log(np.where(keep, ev, 1.0)), 0.0), axis=1)
    scale = np.log(n) if n > 1 else float("nan")
    return [(float(x / scale) if n > 1 else float("nan"), float(x)) for x in h]


def _spectral(e: np.ndarray, pct_k: float) -> list[tuple[str, float]]:
    """G10 + G11 from the entailment slice E (diagonal 1)."""
    m = e.shape[0]
    w = (e + e.T) / 2
    deg = w.sum(axis=1)
    dh = 1.0 / np.sqrt(deg)
    lap = np.eye(m) - dh[:, None] * w * dh[None, :]
    lam, vec = np.linalg.eigh(lap)
    u_eigv = float(np.sum(np.maximum(0.0, 1 - lam)))
    k = int(m * pct_k)
    if k > 0:
        v = vec[:, :k]
        u_ecc = float(np.linalg.norm(v - v.mean(axis=0, keepdims=True)))
    else:
        u_ecc = 0.0
    return [("u_eigv", u_eigv), ("u_ecc", u_ecc)]


def spectral_panel(pairs: DataFrame, items: DataFrame, group_cols: list[str], pct_k: float = ECC_PCT) -> DataFrame:
    """G10, G11, G17–G22 per group in one grouped kernel → long ``(group…, metric, value)``.

    The group's K×K entailment matrix is rebuilt inside the task from its pair
    rows (K = sampled responses). Graphs: unweighted (edge iff weight ≥ 1.5)
    and weighted (manual weights) entailment graphs, as corrected in the docs.
    """
    imp = implication(pairs).select(*group_cols, "i", "j", "p_entail", "label")
    it = items.select(*group_cols, "i", F.lit(None).cast("double").alias("p_entail"),
                      F.lit(None).cast("int").alias("label"), F.lit(None).cast("long").alias("j"))
    data = imp.unionByName(it)
    gfields = [data.schema[g] for g in group_cols]
    schema = T.StructType(gfields + [T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf.loc[pdf["j"].isna(), "i"].unique())
        pos = {v: n for n, v in enumerate(nodes)}
        m = len(nodes)
        e = np.eye(m)
        lab = np.full((m, m), -1)
        pr = pdf[pdf["j"].notna()]
        ii = pr["i"].map(pos).to_numpy()
        jj = pr["j"].astype("int64").map(pos).to_numpy()
        e[ii, jj] = pr["p_entail"].to_numpy()
        lab[ii, jj] = pr["label"].to_numpy()
        rows = _spectral(e, pct_k) if m > 0 else []
        wm = np.zeros((m, m))
        iu = np.triu_indices(m, 1)
        if m > 1:
            l1, l2 = lab[iu], lab.T[iu]
            wv = (l1 == 2) + (l2 == 2) + 0.5 * (l1 == 1) + 0.5 * (l2 == 1)
            wm[iu] = wv
            wm = wm + wm.T
        unweighted = (wm >= EDGE_THRESHOLD).astype(float)
        if m > 0:
            rows += _kernel_panel(unweighted)
            rows += [(WEIGHTED_PREFIX + k, v) for k, v in _kernel_panel(wm)]
        out = pd.DataFrame(rows, columns=["metric", "value"])
        for g in group_cols:
            out[g] = pdf[g].iloc[0]
        return out[group_cols + ["metric", "value"]]

    from .grouped import map_sorted_groups, per_group

    names = [f.name for f in schema.fields]
    return map_sorted_groups(data, group_cols, per_group(kernel, group_cols, names), schema)


# ---------------------------------------------------------------- LUQ

def luq(statements: DataFrame, responses: DataFrame, group_cols: list[str], idx_col: str = "response_idx",
        text_col: str = "response", scorer=None) -> tuple[DataFrame, DataFrame]:
    """G3 + G4: LUQ confidence per response and uncertainty per group.

    S(i, j) = mean over i's statements of the statement-level entailment
    probability against response j (G2), S(i, i) = 1; confidence_i =
    (Σ_j S(i, j) − 1)/(K − 1); uncertainty = mean(1 − confidence).

    With the default lexical scorer (containment) the sum over j decomposes
    over tokens: Σ_{j≠i} c(s, r_j) = (1/|T(s)|) Σ_{t∈T(s)} (df_g(t) − [t in r_i]), where
    df_g(t) counts the group's responses containing t – so no pair table is
    built at all, and statements need not be verbatim parts of their response. A model scorer ``scorer(statement_text, response_text)`` uses
    the statement × other-response join (C12) instead.
    """
    keys = group_cols + [idx_col]
    k = responses.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("k"))
    n_st = statements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_st"))
    if scorer is None:
        rt = responses.select(*keys, F.explode(F.array_distinct(TX.tokens(F.col(text_col)))).alias("tok"))
        df = rt.groupBy(*group_cols, "tok").agg(F.count(F.lit(1)).alias("df"))
        st = statements.select(*keys, "statement_idx", F.array_distinct(TX.tokens(F.col("text"))).alias("_t"))
        st_tok = st.select(*keys, "statement_idx", F.size("_t").alias("_nt"), F.explode("_t").alias("tok"))
        own = rt.withColumn("_own", F.lit(1))
        per_st = st_tok.join(df, group_cols + ["tok"]).join(own, keys + ["tok"], "left").groupBy(*keys, "statement_idx").agg(
            (F.sum(F.col("df") - F.coalesce("_own", F.lit(0))) / F.first("_nt")).alias("_sum_c"))
        s_sum = per_st.groupBy(*keys).agg(F.sum("_sum_c").alias("_sum"))
    else:
        r = responses.select(*group_cols, F.col(idx_col).alias("_j"), F.col(text_col).alias("_rt"))
        pairs = statements.join(r, group_cols).filter(F.col(idx_col) != F.col("_j"))
        per_st = pairs.withColumn("_c", scorer(F.col("text"), F.col("_rt")))
        s_sum = per_st.groupBy(*keys).agg(F.sum("_c").alias("_sum"))
    base = responses.select(*keys).join(k, group_cols).join(n_st, keys, "left").join(s_sum, keys, "left")
    conf = base.select(*keys, "k", F.when((F.col("k") > 1) & (F.col("n_st") > 0),
                                          F.coalesce("_sum", F.lit(0.0)) / F.col("n_st") / (F.col("k") - 1)).alias("confidence"))
    unc = conf.groupBy(*group_cols).agg(
        F.when(F.count("confidence") == F.count(F.lit(1)), F.avg(1 - F.col("confidence"))).alias("uncertainty"))
    return conf, unc


def statement_entailment(statements: DataFrame, responses: DataFrame, group_cols: list[str], scorer, idx_col: str = "response_idx",
                         text_col: str = "response", features=None) -> DataFrame:
    """C12 + G2: ``(group…, i, statement_idx, j, p)``: each statement against every other response of
    its group, an equi-join on the group key. The pair table of a model scorer; its size is
    statements × responses per group by definition. ``features(text)``: what the scorer gets instead of the texts, made
    once for each statement and response, not for each pair."""
    features = features or (lambda text: text)
    st = statements.select(*group_cols, F.col(idx_col).alias("i"), "statement_idx", features(F.col("text")).alias("text"))
    r = responses.select(*group_cols, F.col(idx_col).alias("j"), features(F.col(text_col)).alias("_rt"))
    return st.join(r, group_cols).filter("i <> j").select(*group_cols, "i", "statement_idx", "j", scorer(F.col("text"), F.col("_rt")).alias("p"))


def luq_similarity(statements: DataFrame, responses: DataFrame, group_cols: list[str], idx_col: str = "response_idx",
                   text_col: str = "response", scorer=None) -> DataFrame:
    """G2 + G3: ``(group…, i, j, s)`` for i ≠ j, where s = mean over i's statements of the
    entailment by response j. A response without statements has no rows.

    The table has K(K − 1) rows per group by definition. With the lexical scorer only tokens that
    a statement shares with a response are joined; the rest of the pairs are 0.
    """
    g = group_cols
    st = statements.select(*g, F.col(idx_col).alias("i"), "statement_idx", "text")
    n_st = st.groupBy(*g, "i").agg(F.count(F.lit(1)).alias("_n"))
    if scorer is None:
        tok = responses.select(*g, F.col(idx_col).alias("j"), F.explode(F.array_distinct(TX.tokens(F.col(text_col)))).alias("tok"))
        own = st.select(*g, "i", F.array_distinct(TX.tokens(F.col("text"))).alias("_t")).select(
            *g, "i", F.size("_t").alias("_nt"), F.explode("_t").alias("tok"))
        part = own.join(tok, g + ["tok"]).filter("i <> j").withColumn("_c", 1 / F.col("_nt"))
    else:
        part = statement_entailment(statements, responses, g, scorer, idx_col, text_col).withColumnRenamed("p", "_c")
    total = part.groupBy(*g, "i", "j").agg(F.sum("_c").alias("_s"))
    pairs = n_st.join(responses.select(*g, F.col(idx_col).alias("j")), g).filter("i <> j")
    return pairs.join(total, g + ["i", "j"], "left").select(*g, "i", "j", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("s"))
