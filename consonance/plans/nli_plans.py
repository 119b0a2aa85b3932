"""Registered queries for the entailment family (FX-CONV: group = ``conv_id``, i = turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import entailment as G
from ..session import cut_lineage
from . import fixtures as FX
from .registry import register
from .statement_plans import SQL_STATEMENTS_CTE, sql_containment, sql_tokens

GRP = ["conv_id"]


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.conv_responses(spark, sf_dir)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("conv_id", F.col("response_idx").alias("i"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nli_pairs(_responses(spark, sf_dir), GRP)


def _upairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered two-direction pairs: for the operators that need both directions."""
    return G.nli_pairs_unordered(_responses(spark, sf_dir), GRP)


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


SQL_PAIRS = f"""
r AS (SELECT conv_id, CAST(turn AS INTEGER) AS i, list_distinct({sql_tokens('text')}) AS tk FROM conversations),
cc AS (SELECT a.conv_id, a.i, b.i AS j, {sql_containment('a.tk', 'b.tk')} AS c
       FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.i <> b.i),
pr AS (SELECT conv_id, i, j, (1 - c) * (1 - c) AS p_contra, 2 * c * (1 - c) AS p_neutral, c * c AS p_entail FROM cc),
imp AS (SELECT *, CAST(CASE WHEN p_contra >= p_neutral AND p_contra >= p_entail THEN 0
                            WHEN p_neutral >= p_entail THEN 1 ELSE 2 END AS INTEGER) AS label,
               greatest(p_contra, p_neutral, p_entail) AS confidence FROM pr),
un AS (SELECT a.conv_id, a.i, a.j, a.label AS l_ij, b.label AS l_ji, a.confidence AS c_ij, b.confidence AS c_ji
       FROM imp a JOIN imp b ON a.conv_id = b.conv_id AND a.i = b.j AND a.j = b.i WHERE a.i < a.j)
"""

SQL_CLUSTERS = """
eqv AS (SELECT conv_id, i, j FROM un WHERE l_ij <> 0 AND l_ji <> 0 AND NOT (l_ij = 1 AND l_ji = 1)),
items AS (SELECT conv_id, CAST(turn AS BIGINT) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
          FROM conversations),
adj AS (SELECT it.conv_id, it.i, it.rn, coalesce(list(CAST(e.i AS BIGINT)) FILTER (WHERE e.i IS NOT NULL), []) AS adj
        FROM items it LEFT JOIN eqv e ON e.conv_id = it.conv_id AND e.j = it.i GROUP BY it.conv_id, it.i, it.rn),
fold AS (
  SELECT conv_id, rn, i, [i] AS heads, 0 AS cid FROM adj WHERE rn = 1
  UNION ALL
  SELECT a.conv_id, a.rn, a.i,
         CASE WHEN len(list_intersect(f.heads, a.adj)) = 0 THEN list_append(f.heads, a.i) ELSE f.heads END,
         CASE WHEN len(list_intersect(f.heads, a.adj)) = 0 THEN len(f.heads)
              ELSE list_position(f.heads, list_max(list_intersect(f.heads, a.adj))) - 1 END
  FROM fold f JOIN adj a ON a.conv_id = f.conv_id AND a.rn = f.rn + 1),
ids AS (SELECT conv_id, i, CAST(cid AS INTEGER) AS cluster_id FROM fold)
"""


@register("g1_nli_pairs", sql=f"""WITH {SQL_PAIRS}
SELECT conv_id, i, j, round(p_contra, 6) AS p_contra, round(p_neutral, 6) AS p_neutral, round(p_entail, 6) AS p_entail FROM pr""")
def nli_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: 3-way NLI probabilities (lexical stand-in) for every ordered pair of turns."""
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "i", "j", *_r6("p_contra", "p_neutral", "p_entail"))


@register("g5_implication", sql=f"""WITH {SQL_PAIRS}
SELECT conv_id, i, j, label, round(confidence, 6) AS confidence FROM imp""")
def implication(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.implication(_pairs(spark, sf_dir))
    return p.select("conv_id", "i", "j", "label", *_r6("confidence"))


@register("g6_equivalence", sql=f"""WITH {SQL_PAIRS}
SELECT conv_id, i, j, (l_ij <> 0 AND l_ji <> 0 AND NOT (l_ij = 1 AND l_ji = 1)) AS equivalent,
       (l_ij = 2 AND l_ji = 2) AS equivalent_strict FROM un""")
def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.equivalence(_upairs(spark, sf_dir), GRP).select("conv_id", "i", "j", "equivalent", "equivalent_strict")


@register("g7_semantic_ids", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS}
SELECT conv_id, i, cluster_id FROM ids""")
def semantic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy, order-dependent semantic clusters per conversation."""
    return G.semantic_ids(_upairs(spark, sf_dir), _items(spark, sf_dir), GRP)


@register("g7_semantic_ids_rounds", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS}
SELECT conv_id, i, cluster_id FROM ids""")
def semantic_ids_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 by rounds of joins, the form for groups of any size."""
    return G.semantic_ids_rounds(_upairs(spark, sf_dir), _items(spark, sf_dir), GRP)


@register("g8_semantic_entropy", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS},
cnt AS (SELECT conv_id, cluster_id, count(*) AS n FROM ids GROUP BY ALL),
p AS (SELECT conv_id, n * 1.0 / sum(n) OVER (PARTITION BY conv_id) AS p FROM cnt)
SELECT conv_id, round(-sum(p * ln(p)), 6) AS entropy, CAST(count(*) AS BIGINT) AS n_clusters FROM p GROUP BY conv_id""")
def semantic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 = E7 on G7's ids."""
    ids = G.semantic_ids(_upairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    e = G.cluster_entropy(ids, GRP)
    return e.select("conv_id", *_r6("entropy"), "n_clusters")


@register("g9_degree_uncertainty", sql=f"""WITH {SQL_PAIRS},
m AS (SELECT conv_id, count(*) AS m FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, sum(p_entail) AS s FROM pr GROUP BY conv_id)
SELECT conv_id, m, round(1 - (m + coalesce(s, 0)) / (m * m), 6) AS u_deg FROM m LEFT JOIN s USING (conv_id)""")
def degree_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degree_uncertainty(_pairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    return d.select("conv_id", "m", *_r6("u_deg"))


SQL_SELFCHECK = f"""WITH {SQL_PAIRS},
m AS (SELECT conv_id, count(*) AS m FROM conversations GROUP BY conv_id),
rs AS (SELECT conv_id, i, sum(exp(p_contra) / (exp(p_contra) + exp(p_entail))) AS s FROM pr GROUP BY ALL),
sn AS (SELECT c.conv_id, CAST(c.turn AS INTEGER) AS i, (coalesce(rs.s, 0) + 1 / (1 + exp(1))) / m.m AS s_nli
       FROM conversations c JOIN m USING (conv_id) LEFT JOIN rs ON rs.conv_id = c.conv_id AND rs.i = c.turn)
"""


@register("g12_selfcheck_response", sql=SQL_SELFCHECK + "SELECT conv_id, i, round(s_nli, 6) AS s_nli FROM sn")
def selfcheck_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _u = G.selfcheck(_pairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    return s.select("conv_id", "i", *_r6("s_nli"))


@register("g12_selfcheck_group", sql=SQL_SELFCHECK + "SELECT conv_id, round(avg(1 - s_nli), 6) AS u_nli FROM sn GROUP BY conv_id")
def selfcheck_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    _s, u = G.selfcheck(_pairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    return u.select("conv_id", *_r6("u_nli"))


SQL_WEIGHT = ("CAST((l_ij = 2)::INT + (l_ji = 2)::INT + 0.5 * (l_ij = 1)::INT + 0.5 * (l_ji = 1)::INT AS DOUBLE)")


@register("g13_entailment_graph", sql=f"""WITH {SQL_PAIRS}
SELECT conv_id, i, j, 1.0 AS weight, 'unweighted' AS kind FROM un WHERE {SQL_WEIGHT} >= 1.5
UNION ALL
SELECT conv_id, i, j, round({SQL_WEIGHT}, 6) AS weight, 'manual' AS kind FROM un WHERE {SQL_WEIGHT} > 0
UNION ALL
SELECT conv_id, i, j, round(c_ij + c_ji, 6) AS weight, 'deberta' AS kind FROM un WHERE {SQL_WEIGHT} > 0""")
def entailment_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted (≥ 1.5) and weighted (manual / max-probability) entailment graphs."""
    return G.entailment_graphs(_upairs(spark, sf_dir), GRP).select("conv_id", "i", "j", *_r6("weight"), "kind")


@register("g14_cluster_graph", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS},
e AS (SELECT conv_id, i, j, {SQL_WEIGHT} AS w FROM un WHERE {SQL_WEIGHT} > 0)
SELECT e.conv_id, least(a.cluster_id, b.cluster_id) AS c1, greatest(a.cluster_id, b.cluster_id) AS c2,
       round(sum(w), 6) AS weight
FROM e JOIN ids a ON a.conv_id = e.conv_id AND a.i = e.i JOIN ids b ON b.conv_id = e.conv_id AND b.i = e.j
GROUP BY ALL""")
def cluster_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _upairs(spark, sf_dir)
    ids = G.semantic_ids(p, _items(spark, sf_dir), GRP)
    edges = G.entailment_graph(p, GRP, weighted=True).withColumn("i", F.col("i").cast("long")).withColumn(
        "j", F.col("j").cast("long"))
    c = G.cluster_graph(edges, ids, GRP)
    return c.select("conv_id", "c1", "c2", *_r6("weight"))


@register("g15_cluster_order", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS}
SELECT conv_id, i, cluster_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY cluster_id, i) - 1 AS INTEGER) AS position FROM ids""")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = G.semantic_ids(_upairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    return G.order_by_cluster(ids, GRP)


@register("g16_laplacian", sql=f"""WITH {SQL_PAIRS},
e AS (SELECT conv_id, i, j, {SQL_WEIGHT} AS w FROM un WHERE {SQL_WEIGHT} > 0),
b AS (SELECT conv_id, i, j, w FROM e UNION ALL SELECT conv_id, j AS i, i AS j, w FROM e),
d AS (SELECT conv_id, i, sum(w) AS d FROM b GROUP BY ALL),
n AS (SELECT c.conv_id, CAST(c.turn AS INTEGER) AS i, coalesce(d.d, 0) AS d FROM conversations c
      LEFT JOIN d ON d.conv_id = c.conv_id AND d.i = c.turn)
SELECT conv_id, i, i AS j, round(d, 6) AS value, 'plain' AS kind FROM n
UNION ALL SELECT conv_id, i, j, round(-w, 6), 'plain' FROM b
UNION ALL SELECT conv_id, i, i, CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END, 'normalized' FROM n
UNION ALL SELECT b.conv_id, b.i, b.j, round(-b.w / sqrt(di.d * dj.d), 6), 'normalized'
FROM b JOIN d di ON di.conv_id = b.conv_id AND di.i = b.i JOIN d dj ON dj.conv_id = b.conv_id AND dj.i = b.j""")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and normalised Laplacian entries of the weighted entailment graph."""
    p = _upairs(spark, sf_dir)
    # six references to the edge table below: write it once
    e = cut_lineage(G.entailment_graph(p, GRP, weighted=True))
    items = _items(spark, sf_dir)
    a = G.laplacian(e, items, GRP).withColumn("kind", F.lit("plain"))
    b = G.laplacian(e, items, GRP, normalized=True).withColumn("kind", F.lit("normalized"))
    return a.unionByName(b).select("conv_id", "i", "j", *_r6("value"), "kind")


@register("g10_g22_spectral_panel")
def spectral_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, G11, G17–G22 (U_eigv, U_ecc, 128 kernel entropies) per conversation."""
    return G.spectral_panel(_pairs(spark, sf_dir), _items(spark, sf_dir), GRP)


SQL_LUQ = f"""WITH {SQL_STATEMENTS_CTE},
r AS (SELECT conv_id, CAST(turn AS INTEGER) AS j, list_distinct({sql_tokens('text')}) AS rt FROM conversations),
k AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY conv_id),
sij AS (SELECT st.conv_id, st.response_idx AS i, r.j, avg({sql_containment(sql_tokens('st.text'), 'r.rt')}) AS s
        FROM st JOIN r ON st.conv_id = r.conv_id AND st.response_idx <> r.j GROUP BY ALL),
ssum AS (SELECT conv_id, i, sum(s) AS s FROM sij GROUP BY ALL),
conf AS (SELECT c.conv_id, CAST(c.turn AS INTEGER) AS response_idx, k.k,
                CASE WHEN k.k > 1 THEN ssum.s / (k.k - 1) END AS confidence
         FROM conversations c JOIN k USING (conv_id) LEFT JOIN ssum ON ssum.conv_id = c.conv_id AND ssum.i = c.turn)
"""


@register("g3_luq_confidence", sql=SQL_LUQ + "SELECT conv_id, response_idx, k, round(confidence, 6) AS confidence FROM conf")
def luq_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G3: LUQ confidence per response (token-frequency form of the lexical scorer)."""
    conf, _ = G.luq(FX.conv_statements(spark, sf_dir), _responses(spark, sf_dir), GRP)
    return conf.select("conv_id", "response_idx", "k", *_r6("confidence"))


@register("c12_g2_statement_entailment", sql=f"""WITH {SQL_STATEMENTS_CTE},
r AS (SELECT conv_id, CAST(turn AS INTEGER) AS j, list_distinct({sql_tokens('text')}) AS rt FROM conversations)
SELECT st.conv_id, st.response_idx AS i, st.statement_idx, r.j, round({sql_containment(sql_tokens('st.text'), 'r.rt')}, 6) AS p
FROM st JOIN r ON st.conv_id = r.conv_id AND st.response_idx <> r.j""")
def statement_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 + G2: every statement against every other response of its conversation, by the pair scorer."""
    p = G.statement_entailment(FX.conv_statements(spark, sf_dir), _responses(spark, sf_dir), GRP, TX.containment, features=TX.token_set)
    return p.select("conv_id", "i", "statement_idx", "j", *_r6("p"))


@register("g3_luq_similarity", sql=SQL_LUQ + "SELECT conv_id, i, j, round(s, 6) AS s FROM sij")
def luq_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S(i, j), the mean entailment of response i's statements by response j."""
    s = G.luq_similarity(FX.conv_statements(spark, sf_dir), _responses(spark, sf_dir), GRP)
    return s.select("conv_id", "i", "j", *_r6("s"))


@register("g4_luq_uncertainty", sql=SQL_LUQ + """SELECT conv_id,
  round(CASE WHEN count(confidence) = count(*) THEN avg(1 - confidence) END, 6) AS uncertainty FROM conf GROUP BY conv_id""")
def luq_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unc = G.luq(FX.conv_statements(spark, sf_dir), _responses(spark, sf_dir), GRP)
    return unc.select("conv_id", *_r6("uncertainty"))


SQL_LL = f"""ll AS (SELECT conv_id, CAST(turn AS BIGINT) AS i, -ln(1 + len({sql_tokens('text')})) AS ll FROM conversations)"""


@register("e8_e9_predictive_entropy", sql=f"""WITH {SQL_LL}
SELECT conv_id, round(-avg(ll), 6) AS predictive_entropy, round(-sum(exp(ll) * ll), 6) AS predictive_entropy_rao
FROM ll GROUP BY conv_id""")
def predictive_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 + E9 on a per-response log-likelihood stand-in, −ln(1 + words)."""
    r = _responses(spark, sf_dir).select("conv_id", (-F.log1p(TX.word_count(F.col("response")))).alias("ll"))
    return r.groupBy("conv_id").agg(F.round(-F.avg("ll"), 6).alias("predictive_entropy"),
                                    F.round(-F.sum(F.exp("ll") * F.col("ll")), 6).alias("predictive_entropy_rao"))


@register("e10_logsumexp_by_cluster", sql=f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_CLUSTERS}, {SQL_LL},
j AS (SELECT ids.conv_id, ids.cluster_id, ll.ll FROM ids JOIN ll USING (conv_id, i)),
c AS (SELECT conv_id, cluster_id, ln(sum(exp(ll))) AS lse, count(*) AS n FROM j GROUP BY ALL),
t AS (SELECT conv_id, ln(sum(exp(ll))) AS tot FROM j GROUP BY ALL)
SELECT conv_id, cluster_id, 'sum' AS mode, round(lse - 5.0, 6) AS value FROM c
UNION ALL SELECT conv_id, cluster_id, 'mean', round(lse - ln(n), 6) FROM c
UNION ALL SELECT conv_id, cluster_id, 'sum_normalized', round(lse - tot, 6) FROM c JOIN t USING (conv_id)""")
def logsumexp_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp of response log-likelihoods per semantic cluster, three modes."""
    ids = G.semantic_ids(_upairs(spark, sf_dir), _items(spark, sf_dir), GRP)
    ll = _responses(spark, sf_dir).select("conv_id", F.col("response_idx").cast("long").alias("i"),
                                          (-F.log1p(TX.word_count(F.col("response")))).alias("ll"))
    j = ids.join(ll, ["conv_id", "i"])
    out = None
    for mode in ("sum", "mean", "sum_normalized"):
        part = G.logsumexp_by_cluster(j, GRP, "cluster_id", "ll", agg=mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out.select("conv_id", "cluster_id", "mode", *_r6("value"))
