"""Canonical tables derived by Spark from the driver tables (see FIXTURES.md §2).

* response groups: ``conversations`` – group ``conv_id``, ``response_idx`` = turn
* statements: each turn split after '.' / newline
* judge stand-in (dry-run labelling): a statement is True when at least half of
  its tokens occur in the group's reference text (turn 0); a statement without
  tokens cannot be classified, so its class tag is missing (exercises D2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import statements as ST
from ..session import by_group
from ..sources.tables import table

GROUP = ["conv_id"]
RESP = ["conv_id", "response_idx"]


def conv_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, hash-partitioned by response: windows, joins and groupings by response reuse it."""
    c = table(spark, sf_dir, "conversations")
    return by_group(c.select("conv_id", F.col("turn").cast("int").alias("response_idx"), "role",
                             F.col("text").alias("response")), RESP)


def conv_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.split_statements(conv_responses(spark, sf_dir), RESP, "response")


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference text per group: the opening turn."""
    return (table(spark, sf_dir, "conversations").filter(F.col("turn") == 0)
            .select("conv_id", F.col("text").alias("reference")))


def _judge_prob(stmt: Column, ref_tokens: Column) -> Column:
    return TX.containment(TX.tokens(stmt), ref_tokens)


def judged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with the stand-in judge's tagged output and its token trace."""
    r = conv_responses(spark, sf_dir).join(reference_texts(spark, sf_dir), "conv_id", "left")
    r = r.select(*RESP, "response",
                 F.array_distinct(F.coalesce(TX.tokens(F.col("reference")), F.array().cast("array<string>"))).alias("_rt"),
                 TX.statements(F.col("response")).alias("_ss"))
    # Per-statement features computed once: the reference tokens enter the lambda via
    # array_repeat so they are not re-derived for every statement.
    feats = F.zip_with("_ss", F.array_repeat("_rt", F.size("_ss")), lambda s, rt: F.struct(
        s.alias("s"), (F.size(TX.tokens(s)) > 0).alias("has"), _judge_prob(s, rt).alias("p")))
    r = r.select(*RESP, "response", feats.alias("_f"))

    def tagged_one(x):
        cls = F.when(x["p"] >= 0.5, F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.lit("<statement>"), x["s"], F.lit("</statement>"),
                        F.when(~x["has"], F.lit("")).otherwise(F.concat(F.lit("<class>"), cls, F.lit("</class>"))))

    def trace_one(x):
        s, p, has = x["s"], x["p"], x["has"]
        cls = F.when(p >= 0.5, F.lit("1")).otherwise(F.lit("0"))
        chosen = F.when(p >= 0.5, p).otherwise(1 - p)
        toks_cls = F.array(F.lit("<statement>"), s, F.lit("</statement>"), F.lit("<class>"), cls,
                           F.lit("</class>"), F.lit("\n"))
        toks_plain = F.array(F.lit("<statement>"), s, F.lit("</statement>"), F.lit("\n"))
        z = F.lit(0.0)
        lp_cls = F.array(z, z, z, z, F.log(chosen), z, z)
        lp_plain = F.array(z, z, z, z)
        empty = F.create_map().cast("map<string,double>")
        alts = F.filter(F.array(F.struct(F.lit("1").alias("k"), p.alias("v")),
                                F.struct(F.lit("0").alias("k"), (1 - p).alias("v"))), lambda e: e["v"] > 0)
        top_alt = F.map_from_entries(F.transform(alts, lambda e: F.struct(e["k"], F.log(e["v"]))))
        top_cls = F.array(empty, empty, empty, empty, top_alt, empty, empty)
        top_plain = F.array(empty, empty, empty, empty)
        return F.struct(F.when(has, toks_cls).otherwise(toks_plain).alias("t"),
                        F.when(has, lp_cls).otherwise(lp_plain).alias("l"),
                        F.when(has, top_cls).otherwise(top_plain).alias("m"))

    traced = r.select(*RESP, "response", F.array_join(F.transform("_f", tagged_one), "\n").alias("judge_output"),
                      F.transform("_f", trace_one).alias("_tr"))
    return traced.select(
        *RESP, "response", "judge_output",
        F.flatten(F.transform("_tr", lambda x: x["t"])).alias("tokens"),
        F.flatten(F.transform("_tr", lambda x: x["l"])).alias("logprobs"),
        F.flatten(F.transform("_tr", lambda x: x["m"])).alias("top"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-LAB: group = ``source``, response = ``lang``, statement = labelled document
    (ordered by ``doc_id``), class = ``quality = 1``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id")
