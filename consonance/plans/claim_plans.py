"""Registered queries for the claim graph. Corpus form (FX-BM): claims = ``benchmark`` items, responses =
``documents``, group = document ``source``, support = verbatim containment. Question form: one graph per
conversation, from its statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as H
from ..operators import paths as PA
from ..session import cut_lineage, spread_scan
from ..sources.tables import table
from . import fixtures as FX
from .registry import register
from .statement_plans import SQL_STATEMENTS_CTE

GRP = ["source"]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    items = table(spark, sf_dir, "benchmark")
    e = H.containment_edges(items, docs, "item_id", "text", "doc_id", "text")
    return e.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def _claims(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    e = edges if edges is not None else _edges(spark, sf_dir)
    occ = e.join(items, "item_id").select("source", "doc_id", F.col("item_id").alias("claim_id"), "text")
    return H.claim_union(occ, GRP, ["doc_id"], "text")


def _graph(spark: SparkSession, sf_dir: str):
    # The edge table feeds the claim union, the node tables, degrees and centralities;
    # write it once instead of re-running the n-gram index join per reference.
    raw = cut_lineage(_edges(spark, sf_dir))
    claims = _claims(spark, sf_dir, raw)
    edges = raw.select("source", F.col("item_id").alias("claim_id"), F.col("doc_id").alias("response_id"))
    edges = edges.join(claims.select("source", "claim_id"), ["source", "claim_id"], "left_semi")
    resp = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("response_id"))
    return claims, edges, resp


@register("h2_support_edges", sql="""
SELECT d.source, b.item_id, d.doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0""")
def support_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 (+C13): claim–response support edges via the exact n-gram index join."""
    return _edges(spark, sf_dir).select("source", "item_id", "doc_id")


SQL_CLAIMS = r"""
e AS (SELECT d.source, b.item_id, d.doc_id, b.text FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0),
f AS (SELECT source, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS norm,
             arg_min(item_id, (doc_id, item_id)) AS claim_id, min(doc_id) AS first_doc FROM e GROUP BY ALL),
c AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY first_doc, claim_id) - 1 AS INTEGER) AS claim_idx,
             claim_id FROM f)
"""


@register("h1_claim_union", sql=f"WITH {SQL_CLAIMS} SELECT source, claim_idx, claim_id FROM c")
def claim_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: claims of a group in first-occurrence order, exact-normalised duplicates dropped."""
    return _claims(spark, sf_dir).select("source", "claim_idx", "claim_id")


@register("h3_h4_degrees", sql=f"""WITH {SQL_CLAIMS},
ke AS (SELECT e.source, e.item_id, e.doc_id FROM e JOIN c ON c.source = e.source AND c.claim_id = e.item_id)
SELECT c.source, 'claim' AS side, c.claim_id AS node_id,
       CAST((SELECT count(*) FROM ke WHERE ke.source = c.source AND ke.item_id = c.claim_id) AS BIGINT) AS degree FROM c
UNION ALL
SELECT d.source, 'response', d.doc_id,
       CAST((SELECT count(*) FROM ke WHERE ke.source = d.source AND ke.doc_id = d.doc_id) AS BIGINT) FROM documents d""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 + H4: bipartite node tables (isolated nodes kept) with degree."""
    claims, edges, resp = _graph(spark, sf_dir)
    return H.degrees(edges, claims.select("source", "claim_id"), resp, GRP)


# Per-question graphs: group = conversation, atoms = its statements (every fifth one reworded, so that
# claims without support occur), responses = its turns.

CONV = ["conv_id"]
SQL_CONV_GRAPH = f"""{SQL_STATEMENTS_CTE},
atoms AS (SELECT conv_id, response_idx, statement_idx,
                 CASE WHEN statement_idx % 5 = 4 THEN 'Reportedly ' || text ELSE text END AS text FROM st),
f AS (SELECT conv_id, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS norm, arg_min(text, (response_idx, statement_idx)) AS text,
             min((response_idx, statement_idx)) AS first FROM atoms GROUP BY conv_id, norm),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS claim_idx, text FROM f),
e AS (SELECT c.conv_id, 'c' || claim_idx AS src, 'r' || r.turn AS dst FROM c JOIN conversations r ON r.conv_id = c.conv_id AND instr(r.text, c.text) > 0),
nodes AS (SELECT conv_id, 'c' || claim_idx AS node FROM c UNION ALL SELECT conv_id, 'r' || turn FROM conversations),
nn AS (SELECT conv_id, count(*) AS n FROM nodes GROUP BY conv_id),
adj AS (SELECT conv_id, src AS v, dst AS u FROM e UNION ALL SELECT conv_id, dst, src FROM e)
"""


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = FX.conv_statements(spark, sf_dir)
    text = F.when(F.col("statement_idx") % 5 == 4, F.concat(F.lit("Reportedly "), F.col("text"))).otherwise(F.col("text"))
    return st.select("conv_id", "response_idx", F.col("statement_idx").alias("atom_idx"), text.alias("text"))


@register("h2_h4_conversation_claims", sql=f"""WITH {SQL_CONV_GRAPH},
ends AS (SELECT conv_id, src AS node FROM e UNION ALL SELECT conv_id, dst FROM e),
deg AS (SELECT conv_id, node, count(*) AS degree FROM ends GROUP BY ALL)
SELECT nodes.conv_id, nodes.node, coalesce(deg.degree, 0) AS degree FROM nodes LEFT JOIN deg USING (conv_id, node)""")
def conversation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1–H4 from atoms: claims of each conversation with their support in its own turns."""
    _claims, _edges, nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    return nodes.select("conv_id", "node", "degree")


WALK_LENGTH = 24   # longer than any shortest path of the fixture's graphs (the oracle counts walks up to it)


@register("h5_h8_centralities", sql=f"""WITH RECURSIVE {SQL_CONV_GRAPH},
walks(conv_id, s, v, d, cnt) AS (
  SELECT conv_id, v, v, 0, 1.0::DOUBLE FROM (SELECT DISTINCT conv_id, v FROM adj)
  UNION ALL
  SELECT w.conv_id, w.s, a.u, w.d + 1, sum(w.cnt) FROM walks w JOIN adj a ON a.conv_id = w.conv_id AND a.v = w.v
  WHERE w.d < {WALK_LENGTH} GROUP BY w.conv_id, w.s, a.u, w.d),
p AS (SELECT conv_id, s, v, min(d) AS d, arg_min(cnt, d) AS sigma FROM walks GROUP BY ALL),
bet AS (SELECT x.conv_id, x.v, sum(x.sigma * y.sigma / z.sigma) AS b FROM p x JOIN p y ON y.conv_id = x.conv_id AND y.s = x.v
        JOIN p z ON z.conv_id = x.conv_id AND z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY ALL),
clo AS (SELECT conv_id, v, count(*) AS r, sum(d) AS total FROM p WHERE d > 0 GROUP BY ALL)
SELECT nodes.conv_id, nodes.node, round(coalesce(bet.b / ((n - 1) * (n - 2)), 0), 6) AS betweenness,
       round(coalesce((clo.r / clo.total) * (clo.r / (n - 1)), 0), 6) AS closeness
FROM nodes JOIN nn USING (conv_id) LEFT JOIN bet ON bet.conv_id = nodes.conv_id AND bet.v = nodes.node
LEFT JOIN clo ON clo.conv_id = nodes.conv_id AND clo.v = nodes.node""")
def path_centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 + H8: betweenness and closeness of every node of every conversation's claim graph."""
    _claims, edges, nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    n = nodes.groupBy(*CONV).agg(F.count(F.lit(1)).alias("n_nodes"))
    out = nodes.select("conv_id", "node").join(H.path_centralities(edges, n, CONV), ["conv_id", "node"], "left")
    return out.select("conv_id", "node", *[F.round(F.coalesce(m, F.lit(0.0)), 6).alias(m) for m in ("betweenness", "closeness")])


#: Lengths of edges: 2 where the claim's number and the turn's add up to an even one, else 1.
SQL_LENGTH = "CASE WHEN (CAST(substring(src, 2) AS BIGINT) + CAST(substring(dst, 2) AS BIGINT)) % 2 = 0 THEN 2 ELSE 1 END"


def _with_length(edges: DataFrame) -> DataFrame:
    total = F.substring("src", 2, 20).cast("long") + F.substring("dst", 2, 20).cast("long")
    return edges.withColumn("length", F.when(total % 2 == 0, 2).otherwise(1))


def _centralities(nodes: DataFrame, found: DataFrame, *names: str) -> DataFrame:
    out = nodes.select("conv_id", "node").join(found, ["conv_id", "node"], "left")
    return out.select("conv_id", "node", *[F.round(F.coalesce(m, F.lit(0.0)), 6).alias(m) for m in names])


#: Shortest paths of the graph ``step`` (unit edges) between the nodes of ``adj``, from walks up to a length.
def sql_centralities(step: str, length: int) -> str:
    return f"""walks(conv_id, s, v, d, cnt) AS (
  SELECT conv_id, v, v, 0, 1.0::DOUBLE FROM (SELECT DISTINCT conv_id, v FROM adj)
  UNION ALL
  SELECT w.conv_id, w.s, a.u, w.d + 1, sum(w.cnt) FROM walks w JOIN {step} a ON a.conv_id = w.conv_id AND a.v = w.v
  WHERE w.d < {length} GROUP BY w.conv_id, w.s, a.u, w.d),
p AS (SELECT conv_id, s, v, min(d) AS d, arg_min(cnt, d) AS sigma FROM walks WHERE v NOT LIKE '%-%' GROUP BY ALL),
bet AS (SELECT x.conv_id, x.v, sum(x.sigma * y.sigma / z.sigma) AS b FROM p x JOIN p y ON y.conv_id = x.conv_id AND y.s = x.v
        JOIN p z ON z.conv_id = x.conv_id AND z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY ALL),
clo AS (SELECT conv_id, v, count(*) AS r, sum(d) AS total FROM p WHERE d > 0 GROUP BY ALL)"""


@register("h5_h8_weighted", sql=f"""WITH RECURSIVE {SQL_CONV_GRAPH},
le AS (SELECT *, {SQL_LENGTH} AS len FROM e),
unit AS (SELECT conv_id, src AS v, dst AS u FROM le WHERE len = 1
         UNION ALL SELECT conv_id, src, src || '-' || dst FROM le WHERE len = 2 UNION ALL SELECT conv_id, src || '-' || dst, dst FROM le WHERE len = 2),
step AS (SELECT conv_id, v, u FROM unit UNION ALL SELECT conv_id, u, v FROM unit),
{sql_centralities("step", 2 * WALK_LENGTH)}
SELECT nodes.conv_id, nodes.node, round(coalesce(bet.b / ((n - 1) * (n - 2)), 0), 6) AS betweenness,
       round(coalesce((clo.r / clo.total) * (clo.r / (n - 1)), 0), 6) AS closeness
FROM nodes JOIN nn USING (conv_id) LEFT JOIN bet ON bet.conv_id = nodes.conv_id AND bet.v = nodes.node
LEFT JOIN clo ON clo.conv_id = nodes.conv_id AND clo.v = nodes.node""")
def path_centralities_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 + H8 with lengths of edges (some 1, some 2)."""
    _claims, edges, nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    n = nodes.groupBy(*CONV).agg(F.count(F.lit(1)).alias("n_nodes"))
    return _centralities(nodes, PA.path_centralities(_with_length(edges), n, CONV, "length"), "betweenness", "closeness")


@register("h5_betweenness_sampled", sql=f"""WITH RECURSIVE {SQL_CONV_GRAPH},
{sql_centralities("adj", WALK_LENGTH)}
SELECT nodes.conv_id, nodes.node, round(coalesce(bet.b / ((n - 1) * (n - 2)), 0), 6) AS betweenness
FROM nodes JOIN nn USING (conv_id) LEFT JOIN bet ON bet.conv_id = nodes.conv_id AND bet.v = nodes.node""")
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 from sampled sources, by joins; these graphs have fewer nodes than the asked-for error needs sources, so it is
    exact here."""
    _claims, edges, nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    n = nodes.groupBy(*CONV).agg(F.count(F.lit(1)).alias("n_nodes"))
    return _centralities(nodes, PA.betweenness_sampled(edges, n, CONV, error=0.05), "betweenness")


@register("h8_closeness_sketched")
def closeness_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8 from HyperLogLog sketches on the graph of each document source: benchmark claims and the documents that hold them."""
    claims, edges, resp = _graph(spark, sf_dir)
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    e = cut_lineage(edges.select("source", name("c", "claim_id").alias("src"), name("r", "response_id").alias("dst")))
    n = claims.select("source").unionByName(resp.select("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_nodes"))
    return PA.closeness_sketched(e, n, GRP).select("source", "node", F.round("closeness", 6).alias("closeness"))


EIGEN_SQUARINGS = 24


@register("h6_eigenvector", sql=f"""WITH RECURSIVE {SQL_CONV_GRAPH},
own AS (SELECT DISTINCT conv_id, v FROM adj),
a1 AS (SELECT conv_id, v AS i, u AS j, count(*)::DOUBLE AS m FROM adj GROUP BY ALL UNION ALL SELECT conv_id, v, v, 1.0 FROM own),
pw(it, conv_id, i, j, m) AS (
  SELECT 0, conv_id, i, j, m / sqrt(sum(m * m) OVER (PARTITION BY conv_id)) FROM a1
  UNION ALL
  SELECT it + 1, conv_id, i, j, m / sqrt(sum(m * m) OVER (PARTITION BY conv_id)) FROM (
    SELECT x.it, x.conv_id, x.i, y.j, sum(x.m * y.m) AS m FROM pw x JOIN pw y ON y.conv_id = x.conv_id AND y.i = x.j
    WHERE x.it < {EIGEN_SQUARINGS} GROUP BY ALL)),
x AS (SELECT conv_id, i AS node, sum(m) AS x FROM pw WHERE it = {EIGEN_SQUARINGS} GROUP BY ALL)
SELECT conv_id, node, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id)), 5) AS eigenvector FROM x""")
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the entries of the principal eigenvector of every conversation's claim graph."""
    _claims, edges, _nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    return H.eigenvector_exact(edges, CONV).select("conv_id", "node", F.round("eigenvector", 5).alias("eigenvector"))


@register("h6_eigenvector_invariants", sql=f"""WITH {SQL_CONV_GRAPH}
SELECT DISTINCT conv_id, CAST(1 AS DOUBLE) AS norm, true AS not_negative, true AS eigen FROM e""")
def eigenvector_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, checked by what defines it: unit norm, no negative entry, A x = λ x with λ = xᵀ A x on every
    graph (which eigenvector it is, pytest compares with an eigen-solver)."""
    _claims, edges, _nodes = H.claim_graph(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)
    x = cut_lineage(H.eigenvector(edges, CONV))
    both = edges.unionByName(edges.select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    ax = both.join(x.withColumnRenamed("node", "src"), ["conv_id", "src"]).groupBy("conv_id", F.col("dst").alias("node")).agg(F.sum("eigenvector").alias("ax"))
    j = x.join(ax, ["conv_id", "node"])
    lam = j.groupBy("conv_id").agg(F.sum(F.col("eigenvector") * F.col("ax")).alias("lam"))
    return j.join(lam, "conv_id").groupBy("conv_id").agg(
        F.round(F.sum(F.col("eigenvector") * F.col("eigenvector")), 6).alias("norm"), (F.min("eigenvector") > -1e-9).alias("not_negative"),
        (F.max(F.abs(F.col("ax") - F.col("lam") * F.col("eigenvector"))) < 1e-4).alias("eigen"))


@register("h9_h10_claim_metrics")
def claim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9 + H10: from atoms to the claim-side metric table (degree, betweenness, eigenvector, PageRank, closeness)."""
    return H.graph_uncertainty(_atoms(spark, sf_dir), FX.conv_responses(spark, sf_dir), CONV)


COVER_TAU = 0.5


@register("h1_covered_claims_dropped", sql=f"""WITH {SQL_CLAIMS},
ct AS (SELECT c.source, c.claim_idx, list_distinct(list_filter(string_split_regex(lower(b.text), '[^a-z0-9]+'), lambda t: t <> '')) AS tk
       FROM c JOIN benchmark b ON b.item_id = c.claim_id),
cov AS (SELECT DISTINCT j.source, j.claim_idx FROM ct j JOIN ct i ON i.source = j.source AND i.claim_idx < j.claim_idx
        WHERE len(j.tk) > 0 AND len(list_intersect(j.tk, i.tk)) >= ceil(len(j.tk) * {COVER_TAU}))
SELECT c.source, c.claim_idx, c.claim_id FROM c
WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.source = c.source AND cov.claim_idx = c.claim_idx)""")
def covered_claims_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (scored): claims of a group after dropping those covered (containment ≥ 0.5) by an
    earlier claim, via the exact prefix-filtered similarity join."""
    c = _claims(spark, sf_dir, cut_lineage(_edges(spark, sf_dir)))
    kept = H.drop_covered_claims(c, GRP, "claim_idx", "text", COVER_TAU)
    return kept.select("source", "claim_idx", "claim_id")


PR_ITERATIONS = 30


@register("h7_pagerank_iterative", sql=f"""WITH RECURSIVE {SQL_CLAIMS},
edges AS (SELECT e.source AS g, 'c' || e.item_id AS src, 'r' || e.doc_id AS dst FROM e
          JOIN c ON c.source = e.source AND c.claim_id = e.item_id),
nodes AS (SELECT source AS g, 'c' || claim_id AS node FROM c UNION ALL SELECT source, 'r' || doc_id FROM documents),
both_e AS (SELECT g, src, dst FROM edges UNION ALL SELECT g, dst, src FROM edges),
deg AS (SELECT g, src AS node, count(*) AS deg FROM both_e GROUP BY ALL),
nn AS (SELECT g, count(*) AS n FROM nodes GROUP BY g),
info AS (SELECT nodes.g, nodes.node, nn.n, coalesce(deg.deg, 0) AS deg FROM nodes JOIN nn USING (g) LEFT JOIN deg USING (g, node)),
spread AS (SELECT b.g, b.src, b.dst, 1.0 / i.deg AS w FROM both_e b JOIN info i ON i.g = b.g AND i.node = b.src
           UNION ALL SELECT g, node, node, 0.0 FROM info),
pr(it, g, node, r) AS (
  SELECT 0, g, node, 1.0 / n FROM info
  UNION ALL
  SELECT it, g, node, 0.85 * c + 0.85 * dm / n + 0.15 / n FROM (
    SELECT q.it + 1 AS it, q.g, s.dst AS node, sum(q.r * s.w) AS c, max(q.dm) AS dm, max(i.n) AS n
    FROM (SELECT p.*, sum(CASE WHEN i2.deg = 0 THEN p.r ELSE 0 END) OVER (PARTITION BY p.g) AS dm
          FROM pr p JOIN info i2 ON i2.g = p.g AND i2.node = p.node WHERE p.it < {PR_ITERATIONS}) q
    JOIN spread s ON s.g = q.g AND s.src = q.node JOIN info i ON i.g = q.g AND i.node = s.dst
    GROUP BY q.it, q.g, s.dst))
SELECT g AS source, node, round(r, 6) AS rank FROM pr WHERE it = {PR_ITERATIONS}""")
def pagerank_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 (any graph size): PageRank of every claim/response node by iterative joins, 30 rounds."""
    claims, edges, resp = _graph(spark, sf_dir)
    e = edges.select("source", F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("src"),
                     F.concat(F.lit("r"), F.col("response_id").cast("string")).alias("dst"))
    nodes = claims.select("source", F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("node")).unionByName(
        resp.select("source", F.concat(F.lit("r"), F.col("response_id").cast("string")).alias("node")))
    pr = H.pagerank(e, nodes, GRP, iterations=PR_ITERATIONS)
    return pr.select("source", "node", F.round("rank", 6).alias("rank"))
