"""Registered queries for statements, tags, token traces and truncation (D family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import statements as ST
from . import fixtures as FX
from .registry import register

# DuckDB building blocks mirroring fixtures.py (same patterns, same stand-in judge).
SQL_TOKENS = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
SQL_STMTS = r"list_filter(list_transform(regexp_extract_all({x}, '[^.\n]+\.?'), lambda s: trim(s)), lambda s: s <> '')"


def sql_tokens(x: str) -> str:
    return SQL_TOKENS.format(x=x)


def sql_stmts(x: str) -> str:
    return SQL_STMTS.format(x=x)


def sql_containment(p: str, h: str) -> str:
    return (f"CASE WHEN len(list_distinct({p})) = 0 THEN 0.0 "
            f"ELSE len(list_intersect(list_distinct({p}), {h})) / len(list_distinct({p})) END")


SQL_STATEMENTS_CTE = f"""
st AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, unnest(ss) AS text,
         CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS statement_idx
  FROM (SELECT conv_id, turn, {sql_stmts('text')} AS ss FROM conversations))
"""

SQL_JUDGE_CTE = f"""
ref AS (SELECT conv_id, list_distinct({sql_tokens('text')}) AS rt FROM conversations WHERE turn = 0),
jr AS (
  SELECT c.conv_id, CAST(c.turn AS INTEGER) AS response_idx, c.text AS response,
         list_transform({sql_stmts('c.text')}, lambda s:
            '<statement>' || s || '</statement>' ||
            CASE WHEN len({sql_tokens('s')}) = 0 THEN ''
                 ELSE '<class>' || CASE WHEN {sql_containment(sql_tokens('s'), "coalesce(ref.rt, [])")} >= 0.5
                                        THEN '1' ELSE '0' END || '</class>' END) AS parts
  FROM conversations c LEFT JOIN ref USING (conv_id)),
judge AS (SELECT conv_id, response_idx, response, array_to_string(parts, chr(10)) AS judge_output FROM jr)
"""

PAIR_RE = ST.PAIR_PATTERN


@register("d_statement_split", sql=f"WITH {SQL_STATEMENTS_CTE} SELECT conv_id, response_idx, statement_idx, text FROM st")
def statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-CONV statements: each turn split after '.' or a newline."""
    return FX.conv_statements(spark, sf_dir)


@register("d10_token_estimate", sql=f"""
SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_words,
       round(len({sql_tokens('text')}) * (4.0 / 3.0), 6) AS tokens_est
FROM conversations""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = FX.conv_responses(spark, sf_dir)
    return r.select(*FX.RESP, TX.word_count(F.col("response")).alias("n_words"),
                    F.round(TX.token_estimate(F.col("response")), 6).alias("tokens_est"))


TRUNCATE_WORDS = 50


@register("d12_d13_truncate", sql=f"""
WITH {SQL_STATEMENTS_CTE},
w AS (SELECT *, coalesce(sum(len({sql_tokens('text')})) OVER (PARTITION BY conv_id, response_idx ORDER BY statement_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
kept AS (SELECT conv_id, response_idx, CAST(count(*) AS BIGINT) AS n_kept,
                string_agg(text, ' ' ORDER BY statement_idx) AS joined
         FROM w WHERE before < {TRUNCATE_WORDS} GROUP BY conv_id, response_idx),
keys AS (SELECT DISTINCT conv_id, CAST(turn AS INTEGER) AS response_idx FROM conversations)
SELECT k.conv_id, k.response_idx, coalesce(n_kept, 0) AS n_kept,
       CASE WHEN coalesce(joined, '') LIKE '%.' OR coalesce(joined, '') LIKE '%!' THEN coalesce(joined, '')
            ELSE coalesce(joined, '') || '.' END AS truncated
FROM keys k LEFT JOIN kept USING (conv_id, response_idx)""")
def truncate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 + D13 at a budget of 50 words (= 66.7 estimated tokens)."""
    st = FX.conv_statements(spark, sf_dir).withColumn("budget", F.lit(TRUNCATE_WORDS))
    kept = ST.truncate_words(st, FX.RESP, "budget")
    return ST.rebuild_text(kept, FX.RESP, all_keys=FX.conv_responses(spark, sf_dir))


@register("d14_statement_chunks", sql=f"""
WITH {SQL_STATEMENTS_CTE}
SELECT conv_id, response_idx, CAST(floor(statement_idx / 3) AS INTEGER) AS chunk_idx, CAST(count(*) AS BIGINT) AS n_statements
FROM st GROUP BY ALL""")
def statement_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = ST.chunk_ids(FX.conv_statements(spark, sf_dir), 3)
    return st.groupBy(*FX.RESP, "chunk_idx").agg(F.count(F.lit(1)).alias("n_statements"))


@register("d1_parse_tagged", sql=f"""
WITH {SQL_JUDGE_CTE},
p AS (SELECT conv_id, response_idx,
             regexp_extract_all(judge_output, '{PAIR_RE}', 1) AS s,
             regexp_extract_all(judge_output, '{PAIR_RE}', 2) AS c,
             len(regexp_extract_all(judge_output, '<statement>(.*?)</statement>', 1)) AS n
      FROM judge)
SELECT conv_id, response_idx, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS statement_idx,
       trim(unnest(s)) AS text, unnest(c) = '1' AS class
FROM p WHERE len(s) = n""")
def parse_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement, class) pairs from the judge output of every response."""
    good, _bad = ST.parse_tagged(FX.judged_responses(spark, sf_dir), FX.RESP, "judge_output")
    return good


@register("d2_tag_mismatch_rejects", sql=f"""
WITH {SQL_JUDGE_CTE}
SELECT conv_id, response_idx, judge_output, 'statement/class tag mismatch' AS reason FROM judge
WHERE len(regexp_extract_all(judge_output, '{PAIR_RE}', 1))
      <> len(regexp_extract_all(judge_output, '<statement>(.*?)</statement>', 1))""")
def tag_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses rejected because a statement has no class tag."""
    _good, bad = ST.parse_tagged(FX.judged_responses(spark, sf_dir), FX.RESP, "judge_output")
    return bad


@register("d15_strip_tags", sql=f"""
WITH {SQL_JUDGE_CTE}
SELECT conv_id, response_idx,
       replace(replace(replace(replace(judge_output, '<statement>', ''), '</statement>', ''), '<class>', ''), '</class>', '') AS plain
FROM judge""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = FX.judged_responses(spark, sf_dir)
    return j.select(*FX.RESP, TX.strip_tags(F.col("judge_output"),
                                            ["<statement>", "</statement>", "<class>", "</class>"]).alias("plain"))


@register("d3_d4_class_token_probs", sql=f"""
WITH {SQL_STATEMENTS_CTE},
ref AS (SELECT conv_id, list_distinct({sql_tokens('text')}) AS rt FROM conversations WHERE turn = 0),
sp AS (SELECT st.conv_id, st.response_idx, st.statement_idx, st.text,
              {sql_containment(sql_tokens('st.text'), 'coalesce(ref.rt, [])')} AS p
       FROM st LEFT JOIN ref USING (conv_id)
       WHERE len({sql_tokens('st.text')}) > 0),
h AS (SELECT conv_id, response_idx,
             CAST(row_number() OVER (PARTITION BY conv_id, response_idx ORDER BY statement_idx) - 1 AS INTEGER) AS statement_idx,
             CASE WHEN p >= 0.5 THEN '1' ELSE '0' END AS token,
             ln(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END) AS lp,
             CASE WHEN 1 - p > 0 THEN exp(ln(1 - p)) ELSE -1.0 END AS p0r,
             CASE WHEN p > 0 THEN exp(ln(p)) ELSE -1.0 END AS p1r
      FROM sp),
q AS (SELECT *, CASE WHEN abs(p1r - 1.0) <= 1e-8 + 1e-5 AND p0r = -1 THEN 0.0 ELSE p0r END AS p0,
                CASE WHEN abs(p0r - 1.0) <= 1e-8 + 1e-5 AND p1r = -1 THEN 0.0 ELSE p1r END AS p1 FROM h)
SELECT conv_id, response_idx, statement_idx, token, round(lp, 6) AS logprob_raw, round(p0, 6) AS p0, round(p1, 6) AS p1,
       round(exp(lp) / CASE WHEN p0 <> -1 AND p1 <> -1 THEN p0 + p1 ELSE 1.0 END, 6) AS prob_norm
FROM q""")
def class_token_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 + D4: class tokens located in the judge's token trace, with normalised probabilities."""
    j = FX.judged_responses(spark, sf_dir)
    p = ST.class_token_probs(j, FX.RESP)
    return p.select(*FX.RESP, "statement_idx", "token", F.round("logprob_raw", 6).alias("logprob_raw"),
                    F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"),
                    F.round("prob_norm", 6).alias("prob_norm"))


@register("d6_d9_tagged_bodies", sql=f"""
WITH b AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, role,
         'Answer follows. <response>  ' || text || ' </response> end' AS generated,
         '<new_claims>' || chr(10) || array_to_string(list_transform({sql_stmts('text')}, lambda s: ' - ' || s), chr(10)) || chr(10) || '</new_claims>' AS claims_out
  FROM conversations),
x AS (SELECT *, split_part(split_part(generated, '<response>', 2), '</response>', 1) AS inner_text FROM b)
SELECT conv_id, response_idx, regexp_replace(inner_text, '^\\s+|\\s+$', '', 'g') AS body,
       CAST(length(inner_text) - length(regexp_replace(inner_text, '^\\s+', '')) AS INTEGER) AS left_trim_len,
       list_transform(string_split(regexp_replace(split_part(split_part(claims_out, '<new_claims>', 2), '</new_claims>', 1), '^\\s+|\\s+$', '', 'g'), chr(10)),
            lambda s: regexp_replace(trim(s), '^-+', '')) AS claims
FROM x""")
def tagged_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 (body between <response> tags with its left trim) and D9 (new-claim list)."""
    r = FX.conv_responses(spark, sf_dir)
    gen = F.concat(F.lit("Answer follows. <response>  "), F.col("response"), F.lit(" </response> end"))
    claims_out = F.concat(F.lit("<new_claims>\n"),
                          F.array_join(F.transform(TX.statements(F.col("response")), lambda s: F.concat(F.lit(" - "), s)), "\n"),
                          F.lit("\n</new_claims>"))
    b = ST.response_body(gen)
    claims = ST.parse_claim_list(claims_out)
    return r.select(*FX.RESP, b["body"].alias("body"), F.length(b["left_trim"]).alias("left_trim_len"),
                    claims.alias("claims"))


@register("d11_request_cost", sql=f"""
WITH {SQL_STATEMENTS_CTE},
per AS (SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, len({sql_tokens('text')}) AS w FROM conversations),
ns AS (SELECT conv_id, response_idx, count(*) AS n_st FROM st GROUP BY ALL)
SELECT per.conv_id, round(sum((per.w * 2 + 40) * (4.0 / 3.0)), 6) AS labelling_tokens,
       round(sum(((per.w + 40) * (4.0 / 3.0) + coalesce(n_st, 0)) * 3), 6) AS sampled_scoring_tokens
FROM per LEFT JOIN ns USING (conv_id, response_idx) GROUP BY per.conv_id""")
def request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request token budgets per group – labelling (prompt + response + fixed overhead)
    and sampled scoring ((prompt + statements + overhead) × 3 samples); prompts are modelled
    as the response plus a fixed 40-word template."""
    r = FX.conv_responses(spark, sf_dir)
    ns = FX.conv_statements(spark, sf_dir).groupBy(*FX.RESP).agg(F.count(F.lit(1)).alias("n_st"))
    w = TX.word_count(F.col("response"))
    per = r.select(*FX.RESP, w.alias("w")).join(ns, FX.RESP, "left").fillna({"n_st": 0})
    ratio = F.lit(TX.WORDS_TO_TOKENS)
    return per.groupBy("conv_id").agg(
        F.round(F.sum((F.col("w") * 2 + 40) * ratio), 6).alias("labelling_tokens"),
        F.round(F.sum(((F.col("w") + 40) * ratio + F.col("n_st")) * 3), 6).alias("sampled_scoring_tokens"))


@register("d7_d8_logprob_slices", sql=f"""
WITH x AS (SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, {sql_tokens('text')} AS toks,
                  len({sql_tokens(f"coalesce(({sql_stmts('text')})[1], '')")}) AS n_p FROM conversations),
y AS (SELECT *, list_transform(toks, lambda t: -length(t) / 10.0) AS lp,
             list_transform(toks, lambda t: round(greatest(-length(t) / 10.0, -(length(t) + 1) / 10.0), 8)) AS top_max FROM x)
SELECT conv_id, response_idx, CAST(len(toks) - n_p AS INTEGER) AS n_body,
       list_transform(list_slice(lp, n_p + 1, len(toks)), lambda x: round(x, 6)) AS body_lp, list_transform(top_max, lambda x: round(x, 6)) AS top_max
FROM y""")
def logprob_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 (body slice of the logprobs after a prefix, with its length check) and D8 (best
    alternative per token, rounded to 8 digits); prefix = the turn's first statement."""
    r = FX.conv_responses(spark, sf_dir)
    toks = TX.tokens(F.col("response"))
    first = F.coalesce(F.element_at(TX.statements(F.col("response")), 1), F.lit(""))
    d = r.select(*FX.RESP, toks.alias("toks"), F.size(TX.tokens(first)).alias("n_p"))
    d = d.select(*FX.RESP, "toks", "n_p",
                 F.transform("toks", lambda t: -F.length(t) / 10.0).alias("lp"),
                 F.transform("toks", lambda t: F.create_map(t, -F.length(t) / 10.0, F.lit("<alt>"),
                                                            -(F.length(t) + 1) / 10.0)).alias("top"))
    n_b = F.size("toks") - F.col("n_p")
    body = ST.slice_body_logprobs(F.col("lp"), F.col("n_p") + 1, n_b)
    return d.select(*FX.RESP, n_b.alias("n_body"), F.transform(body, lambda x: F.round(x, 6)).alias("body_lp"),
                    F.transform(ST.top_logprob_rounded(F.col("top")), lambda x: F.round(x, 6)).alias("top_max"))
