"""Registered queries for the vector / dispersion family (FX-EMB: group = ``label``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import cut_lineage
from ..sources.tables import table
from .registry import register


def _rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def label_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per label, by the form for groups of any size: a label's rows grow with the table."""
    emb = table(spark, sf_dir, "embeddings")
    good, _rejected = V.normalize_rows(emb, "embedding")
    return V.group_spectra_gram(good.select("label", "embedding"), ["label"], "embedding")


@register("f1_rejected_vectors", sql="""
SELECT vec_id, label, 'zero or non-finite vector norm' AS reason FROM embeddings
WHERE NOT coalesce(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0, false)""")
def rejected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the dispersion queries leave out, with the reason."""
    _good, bad = V.normalize_rows(table(spark, sf_dir, "embeddings"), "embedding")
    return bad.select("vec_id", "label", "reason")


@register("f3_dispersion_by_label")
def dispersion_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 + F4: dispersion score and its ln K normalisation per label (the flagship)."""
    s = label_spectra(spark, sf_dir)
    return _rounded(s.select("label", "k", "dispersion", "dispersion_norm"), ["dispersion", "dispersion_norm"], 9)


@register("f6_eigenscore_by_label")
def eigenscore_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = label_spectra(spark, sf_dir)
    return _rounded(s.select("label", "k", "eigenscore"), ["eigenscore"], 9)


_F7_SQL = """
WITH u AS (
  SELECT label, vec_id,
         list_transform(CAST(embedding AS DOUBLE[]),
             lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u
  FROM embeddings),
p AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS c
  FROM u a JOIN u b ON a.label = b.label)
SELECT label,
       CAST(count(*) FILTER (WHERE i = j) AS BIGINT) AS k,
       round(sum(c) FILTER (WHERE i = j), 6) AS trace,
       round(sum(c * c), 6) AS fro2,
       round(sum(c) FILTER (WHERE i <> j) / (count(*) FILTER (WHERE i <> j)), 6) AS mean_cos,
       round(sum(c * c) / pow(count(*) FILTER (WHERE i = j), 2), 6) AS purity,
       round(-ln(sum(c * c) / pow(count(*) FILTER (WHERE i = j), 2)), 6) AS renyi2
FROM p GROUP BY label
"""


@register("f7_kernel_moments", sql=_F7_SQL)
def kernel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kernel moments that pin the dispersion spectrum (Σλ = trace, Σλ² = ‖Z‖²_F), by the form
    for groups of any size: labels grow with the table."""
    cols = ["trace", "fro2", "mean_cos", "purity", "renyi2"]
    return _rounded(label_spectra(spark, sf_dir).select("label", "k", *cols), cols)


@register("f7_kernel_moments_gram_path", sql=_F7_SQL)
def kernel_moments_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same moments through chunks of rows whose Grams are added up as tiles."""
    good, _rejected = V.normalize_rows(table(spark, sf_dir, "embeddings"), "embedding")
    cols = ["trace", "fro2", "mean_cos", "purity", "renyi2"]
    return _rounded(V.group_spectra_wide(good, ["label"], "embedding", chunk_rows=32).select("label", "k", *cols), cols)


def _wide(emb: DataFrame, times: int) -> DataFrame:
    """Vectors ``times`` as wide with the same cosines: the components turned about by one more place in each part."""
    turned = lambda i: F.concat(F.slice("embedding", i + 1, F.size("embedding")), F.slice("embedding", 1, i))
    return emb.select("label", "vec_id", F.concat(*[turned(i) for i in range(times)]).alias("embedding"))


@register("f5_wide_vectors", sql=_F7_SQL)
def wide_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 at a model's width (24 × 64 = 1,536): the moments are those of the narrow vectors."""
    good, _rejected = V.normalize_rows(_wide(table(spark, sf_dir, "embeddings"), 24), "embedding")
    cols = ["trace", "fro2", "mean_cos", "purity", "renyi2"]
    return _rounded(V.group_spectra_wide(good, ["label"], "embedding").select("label", "k", *cols), cols)


@register("f5_dispersion_gram_path")
def dispersion_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 + F4 by chunks of rows whose Grams are added up as tiles: a third form of the same scores."""
    good, _rejected = V.normalize_rows(table(spark, sf_dir, "embeddings"), "embedding")
    s = V.group_spectra_wide(good, ["label"], "embedding", chunk_rows=32)
    return _rounded(s.select("label", "k", "dispersion", "dispersion_norm"), ["dispersion", "dispersion_norm"], 9)


@register("f5_forms_agree", sql="""
SELECT conv_id, count(*) AS k, true AS same FROM conversations
WHERE len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) > 0 GROUP BY conv_id""")
def forms_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the direct, the Gram and the chunked form give the same scores, on groups that are small by construction."""
    from ..operators.scoring import embedded
    from . import fixtures as FX

    r = embedded(FX.conv_responses(spark, sf_dir).drop("entity"), ["conv_id"])
    good = cut_lineage(V.normalize_rows(r, "vec")[0].select("conv_id", "vec"))
    names = ["dispersion", "eigenscore", "fro2", "mean_cos"]
    # one row per form: the scores agree if their range is nothing (null only where all are: a single response)
    forms = [V.group_spectra(good, ["conv_id"], "vec"), V.group_spectra_gram(good, ["conv_id"], "vec"),
             V.group_spectra_wide(good, ["conv_id"], "vec", chunk_rows=2)]
    rows = forms[0].unionByName(forms[1]).unionByName(forms[2])
    same = F.count(F.lit(1)) == 3
    for n in names:
        same = same & (F.coalesce(F.max(n) - F.min(n), F.lit(0.0)) < 1e-6) & F.count(n).isin(0, 3)
    return rows.groupBy("conv_id", "k").agg(same.alias("same"))


@register("f1_unit_norm_check", sql="""
SELECT label, CAST(count(*) AS BIGINT) AS n_vectors,
       round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS mean_sq_norm_raw,
       round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))))), 6) AS mean_unit_sum,
       CAST(1 AS DOUBLE) AS min_sq_norm_unit, CAST(1 AS DOUBLE) AS max_sq_norm_unit
FROM embeddings
WHERE list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0
GROUP BY label
""")
def unit_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows normalised (zero and non-finite vectors quarantined) – counts, raw norms, sums and norms of the unit rows per label."""
    emb = table(spark, sf_dir, "embeddings")
    good, _ = V.normalize_rows(emb, "embedding")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return good.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.round(F.avg(square(F.col("embedding").cast("array<double>"))), 6).alias("mean_sq_norm_raw"),
        F.round(F.avg(total), 6).alias("mean_unit_sum"), F.round(F.min(square(F.col("u"))), 6).alias("min_sq_norm_unit"),
        F.round(F.max(square(F.col("u"))), 6).alias("max_sq_norm_unit"))


@register("f10_cosine_to_label_centroid", sql="""
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT label, i, avg(x) AS m
      FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY label, i),
cen AS (SELECT label, list(m ORDER BY i) AS centroid FROM d GROUP BY label)
SELECT v.vec_id, v.label,
       round(list_dot_product(v.e, cen.centroid) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(cen.centroid, cen.centroid))), 6) AS cos_to_centroid
FROM v JOIN cen USING (label)
""")
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 (mean pooling per label) + F10 (row cosine of two vector columns)."""
    emb = table(spark, sf_dir, "embeddings")
    tok = emb.select("label", "vec_id", "embedding")
    centroid = V.pool_tokens(tok, ["label"], "vec_id", "embedding", method="mean")
    return emb.join(centroid, "label").select(
        "vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("pooled")), 6).alias("cos_to_centroid"))
