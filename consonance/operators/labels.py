"""Label aggregation (E family): factuality, sample-length consensus, truth estimates,
entropies, run reports.

Judge samples are kept in long form ``(key…, model, sample_idx, statement_idx,
label)`` so a response with many statements is never gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ENTROPY_FLOOR = 1e-10
LENGTH_MISMATCH_REASON = "sampled_labels_mismatch"


def factuality(statements: DataFrame, resp_cols: list[str], class_col: str = "class") -> DataFrame:
    """Share of True statements per response."""
    return statements.groupBy(*resp_cols).agg(F.avg(F.col(class_col).cast("double")).alias("factuality"),
                                               F.count(F.lit(1)).alias("n_statements"))


def group_factuality(resp_fact: DataFrame, group_cols: list[str], order_col: str) -> DataFrame:
    """Ordered factuality vector of a group (one entry per response) and its mean."""
    return resp_fact.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), F.col("factuality")))),
                    lambda s: s[order_col]).alias("order"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), F.col("factuality")))),
                    lambda s: s["factuality"]).alias("factualities"),
        F.avg("factuality").alias("mean_factuality"))


def sample_lengths(samples: DataFrame, key_cols: list[str]) -> DataFrame:
    """Lengths of the samples that have labels; samples without any are not rows of ``samples``
    and must come from a sample table (``inference.label_samples`` gives one with length 0)."""
    return samples.groupBy(*key_cols, "model", "sample_idx").agg(F.count(F.lit(1)).alias("len"))


def length_consensus(samples: DataFrame, n_statements: DataFrame, key_cols: list[str],
                     lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sample-length consensus per (key…, model).

    ``samples``: ``key…, model, sample_idx, statement_idx, label``;
    ``n_statements``: ``key…, n_statements``; ``lengths``: ``key…, model, sample_idx, len`` of
    every sample, empty and failed ones with 0 (default: the lengths found in ``samples``). When the samples' lengths differ,
    the modal length (ties → smallest) must equal the statement count: then
    only samples of that length are kept, otherwise the response is flagged.
    When all lengths agree they pass, with ``length_ok`` telling whether they
    match the statement count. Returns (kept sample rows, per-response status).
    """
    k = key_cols + ["model"]
    lens = (sample_lengths(samples, key_cols) if lengths is None else lengths).select(*k, "sample_idx", F.col("len").cast("long").alias("len"))
    per_len = lens.groupBy(*k, "len").agg(F.count(F.lit(1)).alias("n_samples"))
    w = Window.partitionBy(*k).orderBy(F.desc("n_samples"), F.asc("len"))
    wk = Window.partitionBy(*k)
    mode = per_len.withColumn("_rn", F.row_number().over(w)).withColumn(
        "n_lengths", F.count(F.lit(1)).over(wk)).filter("_rn = 1").select(
        *k, F.col("len").alias("mode_len"), "n_lengths")
    status = mode.join(n_statements, key_cols, "left").withColumn(
        "flagged", (F.col("n_lengths") > 1) & (F.col("mode_len") != F.coalesce("n_statements", F.lit(0)))).withColumn(
        "length_ok", F.col("mode_len") == F.coalesce("n_statements", F.lit(0)))
    keep = lens.join(status.filter(~F.col("flagged")), k).filter(F.col("len") == F.col("mode_len")).select(*k, "sample_idx")
    kept = samples.join(keep, k + ["sample_idx"], "left_semi")
    return kept, status


def split_by_group_flag(status: DataFrame, group_cols: list[str], flag_col: str = "flagged") -> tuple[DataFrame, DataFrame]:
    """A group fails when any of its rows is flagged; returns (ok rows, failed rows)."""
    bad = status.filter(F.col(flag_col)).select(*group_cols).distinct()
    return status.join(bad, group_cols, "left_anti"), status.join(bad, group_cols, "left_semi").withColumn(
        "reason", F.lit(LENGTH_MISMATCH_REASON))


def statement_truth(kept: DataFrame, key_cols: list[str]) -> DataFrame:
    """p(True) of each statement across kept samples and judges; majority = p ≥ 0.5."""
    g = kept.groupBy(*key_cols, "statement_idx").agg(F.avg(F.col("label").cast("double")).alias("p_true"),
                                                     F.count(F.lit(1)).alias("n_votes"))
    return g.withColumn("majority", F.col("p_true") >= 0.5)


def category_entropy(df: DataFrame, group_cols: list[str], cat_col: str) -> DataFrame:
    """−Σ p ln p over category frequencies (zero floor), and ÷ ln n (n = rows)."""
    c = df.groupBy(*group_cols, cat_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols)
    p = c.withColumn("_tot", F.sum("_n").over(w)).withColumn("_p", F.col("_n") / F.col("_tot"))
    p = p.withColumn("_p", F.when(F.col("_p") == 0, F.lit(ENTROPY_FLOOR)).otherwise(F.col("_p")))
    g = p.groupBy(*group_cols).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"),
                                   F.first("_tot").alias("n"), F.count(F.lit(1)).alias("n_categories"))
    return g.withColumn("entropy_scaled", F.when(F.col("n") > 1, F.col("entropy") / F.log(F.col("n").cast("double"))))


def run_report(jobs: DataFrame, group_cols: list[str], required: list[str], status_col: str,
               completed_value: str | None, runtime_col: str, failed_value: str | None = None) -> DataFrame:
    """Total, valid (required fields present and completed), success rate, runtime range."""
    present = F.lit(True)
    for c in required:
        present = present & F.col(c).isNotNull()
    if completed_value is not None:
        done = F.col(status_col) == completed_value
    else:
        done = F.col(status_col) != failed_value
    v = jobs.withColumn("_valid", present & done)
    return v.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("_valid").cast("long")).alias("valid"),
        (F.sum(F.col("_valid").cast("long")) / F.count(F.lit(1))).alias("success_rate"),
        F.min(F.when(F.col("_valid"), F.col(runtime_col))).alias("min_runtime"),
        F.avg(F.when(F.col("_valid"), F.col(runtime_col))).alias("avg_runtime"),
        F.max(F.when(F.col("_valid"), F.col(runtime_col))).alias("max_runtime"))


def throughput(jobs: DataFrame, group_cols: list[str], start_col: str, end_col: str | None = None) -> DataFrame:
    """Jobs ÷ elapsed seconds (first start to last end); null for a zero span."""
    end_col = end_col or start_col
    g = jobs.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("jobs"),
                                      F.min(start_col).alias("_s"), F.max(end_col).alias("_e"))
    span = F.expr("timestampdiff(MICROSECOND, _s, _e)") / 1e6
    return g.select(*group_cols, "jobs", span.alias("elapsed_s"),
                    F.when(span > 0, F.col("jobs") / span).alias("jobs_per_s"))
