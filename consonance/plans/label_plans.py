"""Registered queries for label aggregation and reports (E family, B5/D5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import labels as E
from ..operators import prep as P
from ..operators import statements as ST
from ..sources.tables import table
from . import fixtures as FX
from .registry import register
from .statement_plans import sql_containment, sql_stmts, sql_tokens

RESP = ["source", "lang"]


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FX-LAB judge samples: 0 = quality, 1 = not toxic, 2 = quality over non-toxic docs only, 3 = the
    same for sources with five-letter names, empty for the others (a failed call).

    One join of documents and labels; the samples come from one ``explode``, their lengths (empty
    ones included) from one aggregation."""
    ld = FX.labelled_documents(spark, sf_dir)
    q, nt = F.col("quality") == 1, F.col("toxic") == 0
    x = F.explode(F.array(
        F.struct(F.lit(0).alias("sample_idx"), q.alias("label"), F.lit(True).alias("keep")),
        F.struct(F.lit(1).alias("sample_idx"), nt.alias("label"), F.lit(True).alias("keep")),
        F.struct(F.lit(2).alias("sample_idx"), q.alias("label"), nt.alias("keep")),
        F.struct(F.lit(3).alias("sample_idx"), q.alias("label"), (nt & (F.length("source") == 5)).alias("keep"))))
    samples = (ld.select("source", "lang", F.lit("stand_in").alias("model"), F.col("doc_id").alias("statement_idx"),
                         x.alias("x"))
               .filter(F.col("x.keep"))
               .select("source", "lang", "model", F.col("x.sample_idx").alias("sample_idx"), "statement_idx",
                       F.col("x.label").alias("label")))
    # sample 0 labels every labelled document: its size per response is the statement count
    n = samples.filter(F.col("sample_idx") == 0).groupBy(*RESP).agg(F.count(F.lit(1)).alias("n_statements"))
    size = ld.groupBy(*RESP).agg(F.count(F.lit(1)).alias("n"), F.count_if(nt).alias("m"),
                                 F.count_if(nt & (F.length("source") == 5)).alias("f"))
    lengths = size.select(*RESP, F.lit("stand_in").alias("model"),
                          F.posexplode(F.array("n", "n", "m", "f")).alias("sample_idx", "len"))
    return samples, n, lengths


SQL_LD = """ld AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""
SQL_SAMPLES = SQL_LD + """,
smp AS (SELECT source, lang, 'stand_in' AS model, 0 AS sample_idx, doc_id AS statement_idx, quality = 1 AS label FROM ld
        UNION ALL SELECT source, lang, 'stand_in', 1, doc_id, toxic = 0 FROM ld
        UNION ALL SELECT source, lang, 'stand_in', 2, doc_id, quality = 1 FROM ld WHERE toxic = 0
        UNION ALL SELECT source, lang, 'stand_in', 3, doc_id, quality = 1 FROM ld WHERE toxic = 0 AND length(source) = 5),
ns AS (SELECT source, lang, count(*) AS n_statements FROM ld GROUP BY ALL),
every AS (SELECT DISTINCT source, lang, 'stand_in' AS model, s.s AS sample_idx FROM ld, (SELECT unnest([0, 1, 2, 3]) AS s) s),
lens AS (SELECT e.source, e.lang, e.model, e.sample_idx, count(smp.statement_idx) AS len
         FROM every e LEFT JOIN smp USING (source, lang, model, sample_idx) GROUP BY ALL),
pl AS (SELECT source, lang, model, len, count(*) AS n_samples FROM lens GROUP BY ALL),
md AS (SELECT source, lang, model, len AS mode_len,
              count(*) OVER (PARTITION BY source, lang, model) AS n_lengths,
              row_number() OVER (PARTITION BY source, lang, model ORDER BY n_samples DESC, len ASC) AS rn FROM pl),
status AS (SELECT md.source, md.lang, md.model, mode_len, n_lengths, n_statements,
                  (n_lengths > 1 AND mode_len <> coalesce(n_statements, 0)) AS flagged,
                  (mode_len = coalesce(n_statements, 0)) AS length_ok
           FROM md LEFT JOIN ns USING (source, lang) WHERE rn = 1),
kept AS (SELECT smp.* FROM smp JOIN lens USING (source, lang, model, sample_idx)
         JOIN status USING (source, lang, model) WHERE NOT flagged AND lens.len = status.mode_len)
"""


@register("e1_response_factuality", sql=f"""WITH {SQL_LD}
SELECT source, lang, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS factuality, count(*) AS n_statements FROM ld GROUP BY ALL""")
def response_factuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response factuality = mean(class is True) (FX-LAB: response = lang within source)."""
    ld = FX.labelled_documents(spark, sf_dir).withColumn("class", F.col("quality") == 1)
    f = E.factuality(ld, RESP)
    return f.select(*RESP, *_r6("factuality"), "n_statements")


@register("e2_group_factuality", sql=f"""WITH {SQL_LD},
f AS (SELECT source, lang, avg(CAST(quality = 1 AS DOUBLE)) AS f FROM ld GROUP BY ALL)
SELECT source, list(lang ORDER BY lang) AS "order", list(round(f, 6) ORDER BY lang) AS factualities,
       round(avg(f), 6) AS mean_factuality FROM f GROUP BY source""")
def group_factuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered factuality vector per group and its mean (one entry per response)."""
    ld = FX.labelled_documents(spark, sf_dir).withColumn("class", F.col("quality") == 1)
    g = E.group_factuality(E.factuality(ld, RESP), ["source"], "lang")
    return g.select("source", "order", F.transform("factualities", lambda x: F.round(x, 6)).alias("factualities"),
                    *_r6("mean_factuality"))


@register("e3_length_consensus", sql=f"""WITH {SQL_SAMPLES}
SELECT source, lang, model, mode_len, n_lengths, n_statements, flagged, length_ok FROM status""")
def length_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modal sample length vs statement count, per response and judge."""
    samples, n, lengths = _samples(spark, sf_dir)
    _kept, status = E.length_consensus(samples, n, RESP, lengths)
    return status.select(*RESP, "model", "mode_len", "n_lengths", "n_statements", "flagged", "length_ok")


@register("e4_failed_groups", sql=f"""WITH {SQL_SAMPLES}
SELECT source, lang, model, 'sampled_labels_mismatch' AS reason FROM status
WHERE source IN (SELECT source FROM status WHERE flagged)""")
def failed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response of a group with any flagged response goes to the failure side."""
    samples, n, lengths = _samples(spark, sf_dir)
    _kept, status = E.length_consensus(samples, n, RESP, lengths)
    _ok, bad = E.split_by_group_flag(status, ["source"])
    return bad.select(*RESP, "model", "reason")


@register("e6_statement_truth", sql=f"""WITH {SQL_SAMPLES}
SELECT source, lang, statement_idx, round(avg(CAST(label AS DOUBLE)), 6) AS p_true, count(*) AS n_votes,
       avg(CAST(label AS DOUBLE)) >= 0.5 AS majority FROM kept GROUP BY ALL""")
def statement_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p(True) per statement across the kept samples; majority vote."""
    samples, n, lengths = _samples(spark, sf_dir)
    kept, _ = E.length_consensus(samples, n, RESP, lengths)
    t = E.statement_truth(kept, RESP)
    return t.select(*RESP, "statement_idx", *_r6("p_true"), "n_votes", "majority")


@register("e7_e12_event_type_entropy", sql="""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id) AS tot FROM c)
SELECT user_id, round(-sum((n / tot) * ln(n / tot)), 6) AS entropy, CAST(max(tot) AS BIGINT) AS n,
       count(*) AS n_categories,
       round(CASE WHEN max(tot) > 1 THEN -sum((n / tot) * ln(n / tot)) / ln(max(tot)) END, 6) AS entropy_scaled
FROM p GROUP BY user_id""")
def event_type_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + E11 + E12: entropy of each user's status distribution, and scaled by ln n."""
    ev = table(spark, sf_dir, "events")
    h = E.category_entropy(ev, ["user_id"], "event_type")
    return h.select("user_id", *_r6("entropy"), "n", "n_categories", *_r6("entropy_scaled"))


@register("e13_run_report", sql="""
SELECT user_id, count(*) AS total,
       CAST(sum(CAST(event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL
                AND event_type <> 'error' AS BIGINT)) AS BIGINT) AS valid,
       round(sum(CAST(event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL
                AND event_type <> 'error' AS BIGINT)) / count(*), 6) AS success_rate,
       round(min(value) FILTER (WHERE value IS NOT NULL AND props IS NOT NULL AND ts IS NOT NULL AND event_type <> 'error'), 6) AS min_runtime,
       round(avg(value) FILTER (WHERE value IS NOT NULL AND props IS NOT NULL AND ts IS NOT NULL AND event_type <> 'error'), 6) AS avg_runtime,
       round(max(value) FILTER (WHERE value IS NOT NULL AND props IS NOT NULL AND ts IS NOT NULL AND event_type <> 'error'), 6) AS max_runtime
FROM events GROUP BY user_id""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 over the events ledger: job = event, block = user, status = event_type, runtime = value."""
    ev = table(spark, sf_dir, "events")
    r = E.run_report(ev, ["user_id"], ["event_id", "ts", "value", "props"], "event_type", None, "value",
                     failed_value="error")
    return r.select("user_id", "total", "valid", *_r6("success_rate", "min_runtime", "avg_runtime", "max_runtime"))


@register("e15_throughput", sql="""
SELECT user_id, count(*) AS jobs, round(epoch(max(ts)) - epoch(min(ts)), 6) AS elapsed_s,
       round(CASE WHEN epoch(max(ts)) - epoch(min(ts)) > 0 THEN count(*) / (epoch(max(ts)) - epoch(min(ts))) END, 6) AS jobs_per_s
FROM events GROUP BY user_id""")
def event_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    t = E.throughput(ev, ["user_id"], "ts")
    return t.select("user_id", "jobs", *_r6("elapsed_s", "jobs_per_s"))


@register("b5_d5_numbered_labels", sql=f"""
WITH ref AS (SELECT conv_id, list_distinct({sql_tokens('text')}) AS rt FROM conversations WHERE turn = 0),
x AS (SELECT c.conv_id, CAST(c.turn AS INTEGER) AS response_idx, {sql_stmts('c.text')} AS ss, coalesce(ref.rt, []) AS rt
      FROM conversations c LEFT JOIN ref USING (conv_id)),
y AS (SELECT conv_id, response_idx,
             array_to_string(list_transform(ss, lambda s, i: i || '. <statement>' || s || '</statement>'), chr(10)) AS prompt,
             array_to_string(list_transform(ss, lambda s, i: i || '. ' ||
                 CASE WHEN {sql_containment(sql_tokens('s'), 'rt')} >= 0.5 THEN 'True' ELSE 'False' END), chr(10)) AS answer
      FROM x)
SELECT conv_id, response_idx, md5(prompt) AS prompt_md5,
       CAST(len(regexp_extract_all(answer, '\\d+\\.\\s*(True|False)', 1)) AS INTEGER) AS n_labels,
       CAST(len(list_filter(regexp_extract_all(answer, '\\d+\\.\\s*(True|False)', 1), lambda v: lower(v) = 'true')) AS INTEGER) AS n_true
FROM y""")
def numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 (1-based numbered statement list) + D5 (parse a numbered True/False answer)."""
    r = FX.conv_responses(spark, sf_dir).join(FX.reference_texts(spark, sf_dir), "conv_id", "left")
    rt = F.array_distinct(F.coalesce(TX.tokens(F.col("reference")), F.array().cast("array<string>")))
    ss = TX.statements(F.col("response"))
    prompt = P.numbered_statements(ss)
    answer = F.array_join(F.transform(ss, lambda s, i: F.concat(
        (i + 1).cast("string"), F.lit(". "),
        F.when(TX.containment(TX.tokens(s), rt) >= 0.5, F.lit("True")).otherwise(F.lit("False")))), "\n")
    labels = ST.parse_label_list(answer)
    return r.select(*FX.RESP, F.md5(prompt).alias("prompt_md5"), F.size(labels).alias("n_labels"),
                    F.size(F.filter(labels, lambda v: v)).alias("n_true"))
