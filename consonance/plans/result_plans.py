"""Registered queries for sources/sinks (A), sweeps (I, F11/F12), streaming (J1) and the
inference surface (K). Files are written by Spark from the driver tables into a scratch
folder under the session's shared checkpoint folder, then read back through the operator."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import inference as K
from ..operators import prep as P
from ..operators import scoring as SC
from ..operators import statements as ST
from ..operators import sweep as S
from ..session import checkpoint_dir, cut_lineage
from ..sources import io as IO
from ..sources.tables import table
from ..sources.snapshots import SnapshotTable
from ..streaming import incremental as J
from . import fixtures as FX
from .dispersion_plans import _F7_SQL
from .registry import register
from .nli_plans import SQL_CLUSTERS, SQL_LUQ, SQL_PAIRS
from .statement_plans import SQL_STATEMENTS_CTE, sql_containment, sql_tokens


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex}")


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested response groups (E5 form) from conversations."""
    r = FX.conv_responses(spark, sf_dir)
    lp = F.transform(TX.tokens(F.col("response")), lambda t: -F.length(t) / 10.0)
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("response_idx", F.col("response"), lp.alias("logprobs")))).alias("rs"))
    return g.select(F.col("conv_id").alias("index"), F.lit("conv").alias("idx_cat"),
                    F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("entity"),
                    F.transform("rs", lambda x: F.struct(x["response"].alias("response"), x["logprobs"].alias("logprobs"))).alias("responses"))


@register("a2_e5_group_json_roundtrip", sql="""
SELECT conv_id AS "index", CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS response_idx, text AS response
FROM conversations""")
def group_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 nested assembly → A2 JSON-lines sink/source with an explicit schema → flattened."""
    path = _scratch(spark, "groups")
    _groups(spark, sf_dir).write.mode("overwrite").json(path)
    g = IO.read_groups(spark, path)
    return g.select("index", F.posexplode("responses").alias("response_idx", "r")).select(
        "index", F.col("response_idx").cast("int").alias("response_idx"), F.col("r.response").alias("response"))


@register("a1_json_array_documents", sql="""
SELECT conv_id AS "index", CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS response_idx, text AS response
FROM conversations""")
def json_array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: groups written as files that each hold one JSON array document, read back with
    ``multiLine`` and an explicit schema, flattened."""
    path = _scratch(spark, "group-arrays")
    IO.write_json_array_documents(_groups(spark, sf_dir), path, n_files=4)
    g = IO.read_groups(spark, path, multiline=True)
    return g.select("index", F.posexplode("responses").alias("response_idx", "r")).select(
        "index", F.col("response_idx").cast("int").alias("response_idx"), F.col("r.response").alias("response"))


@register("a17_flatten_export", sql="SELECT 'conversation ' || conv_id AS topic, text AS output FROM conversations")
def flatten_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, output) export lines, one per response."""
    return IO.flatten_export(_groups(spark, sf_dir), "entity")


_METRICS_SQL = f"""WITH m AS ({_F7_SQL})
SELECT 'dispersion' AS metric, 'stand_in' AS model, 0 AS response_count, label, name, value FROM m
UNPIVOT (value FOR name IN (trace, fro2, mean_cos, purity, renyi2))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dispersion_plans import label_spectra

    s = label_spectra(spark, sf_dir)
    names = ["trace", "fro2", "mean_cos", "purity", "renyi2"]
    return s.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value"))
                                                 for n in names])).alias("m")).select(
        F.lit("dispersion").alias("metric"), F.lit("stand_in").alias("model"), F.lit(0).alias("response_count"),
        "label", "m.name", "m.value")


@register("a3_a11_metrics_store", sql=_METRICS_SQL)
def metrics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A11: long metrics table written twice as partitioned Parquet (dynamic partition
    overwrite makes the rerun replace, not duplicate), then read back."""
    long = _metrics(spark, sf_dir)
    path = _scratch(spark, "metrics")
    IO.write_metrics(long, path)
    IO.write_metrics(long, path)
    return spark.read.parquet(path).select("metric", "model", F.col("response_count").cast("int"), "label", "name", "value")


@register("a11_atomic_replace", sql=_METRICS_SQL)
def atomic_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table replaced in one step; readers of the first version (half of the rows) keep it until then."""
    long = _metrics(spark, sf_dir)
    store = SnapshotTable(spark, _scratch(spark, "metrics-table"), ["metric", "model", "label"], buckets=4)
    store.replace(long.filter(F.col("label") % 2 == 0))
    store.replace(long)
    return store.read()


@register("a4_a21_prompt_csv_roundtrip", sql="""
SELECT min(p_partkey) AS "index", arg_min(p_brand, p_partkey) AS idx_cat, p_name AS answer,
       'Write a few paragraphs on ''' || p_name || '''.' AS open_ended_question FROM part GROUP BY p_name""")
def prompt_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 CSV sink with header → A4 CSV source with an explicit schema."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("answer"), F.col("p_partkey").alias("index"),
                                               F.col("p_brand").alias("idx_cat"))
    e = P.keep_first(part, ["answer"], ["index"]).withColumn("open_ended_question", P.entity_question(F.col("answer")))
    path = _scratch(spark, "prompts")
    IO.write_csv(e.select("index", "idx_cat", "answer", "open_ended_question"), path)
    return IO.read_prompts(spark, path)


@register("a5_headerless_tsv", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS wiki_art_id, o_orderpriority AS title, c_name AS author,
       strftime(o_orderdate, '%Y-%m-%d') AS pub_date
FROM orders JOIN customer ON c_custkey = o_custkey""")
def headerless_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a seven-column headerless TSV read with positional names."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    t = o.select(F.col("o_orderkey").cast("string"), F.concat(F.lit("/m/"), F.col("o_orderkey").cast("string")),
                 "o_orderpriority", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("{}"),
                 F.lit("plot"))
    path = _scratch(spark, "books")
    t.write.mode("overwrite").option("sep", "\t").csv(path)
    b = IO.read_book_tsv(spark, path)
    return b.select("wiki_art_id", "title", "author", "pub_date")


@register("a6_entity_list", sql="SELECT DISTINCT p_name AS entity FROM part")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity per line (padded, with blank lines) read and trimmed."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    lines = names.select(F.explode(F.array(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")), F.lit(""))).alias("value"))
    path = _scratch(spark, "entities")
    lines.write.mode("overwrite").text(path)
    return IO.read_entity_list(spark, path).distinct()


@register("a8_split_read", sql="""
SELECT 'documents' AS split, doc_id, md5(text) AS text_md5, NULL AS quality FROM documents
UNION ALL SELECT 'labels', doc_id, NULL, quality FROM labels""")
def split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split-labelled multi-path read (schemas unioned by name)."""
    d = IO.read_splits(spark, {"documents": f"{sf_dir}/documents.parquet", "labels": f"{sf_dir}/labels.parquet"})
    return d.select("split", "doc_id", F.md5("text").alias("text_md5"), "quality")


@register("a12_upsert_latest", sql="""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts
FROM events GROUP BY user_id""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two write batches upserted by key, last write (by ts) wins."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    old = ev.filter(F.col("event_type") != "purchase")
    new = ev.filter(F.col("event_type") == "purchase")
    return IO.upsert_latest(old, new, ["user_id"], "ts").select("user_id", "event_id", "event_type", "ts")


@register("a12_snapshot_upsert", sql="""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts
FROM events GROUP BY user_id""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 on a bucketed table: purchases are written into the buckets of their users only, in two writes."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    store = SnapshotTable(spark, _scratch(spark, "users"), ["user_id"], buckets=16)
    store.replace(IO.upsert_latest(ev.filter(F.col("event_type") != "purchase"), ev.limit(0), ["user_id"], "ts"))
    bought = ev.filter(F.col("event_type") == "purchase")
    for part in (0, 1):
        store.upsert(bought.filter(F.col("event_id") % 2 == part), "ts")
    return store.read().select("user_id", "event_id", "event_type", "ts")


@register("a13_append_projection", sql="SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, text AS response FROM conversations")
def append_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends projected to the fixed field list, read back."""
    r = FX.conv_responses(spark, sf_dir)
    path = _scratch(spark, "append")
    fields = ["conv_id", "response_idx", "response"]
    IO.append_projected(r.filter(F.col("role") == "user"), fields).write.mode("append").parquet(path)
    IO.append_projected(r.filter(F.col("role") != "user"), fields).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("a14_merge_extend", sql="""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) - 1 AS INTEGER) AS response_idx,
       CAST(turn AS INTEGER) AS turn, md5(text) AS text_md5 FROM conversations""")
def merge_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are the existing list; other turns extend it; indices renumbered."""
    r = FX.conv_responses(spark, sf_dir).withColumn("turn", F.col("response_idx"))
    old = r.filter(F.col("role") == "user").withColumn("batch", F.lit(0))
    new = r.filter(F.col("role") != "user").withColumn("batch", F.lit(1))
    return IO.merge_extend(old, new, ["conv_id"]).select("conv_id", "response_idx", "turn", F.md5("response").alias("text_md5"))


@register("a14_snapshot_extend", sql="""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) - 1 AS INTEGER) AS response_idx,
       CAST(turn AS INTEGER) AS turn, md5(text) AS text_md5 FROM conversations""")
def snapshot_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 on a bucketed table: other turns extend the lists of user turns in the buckets that hold them."""
    r = FX.conv_responses(spark, sf_dir).withColumn("turn", F.col("response_idx"))
    store = SnapshotTable(spark, _scratch(spark, "lists"), ["conv_id"], buckets=16)
    store.replace(r.filter(F.col("role") == "user").withColumn("batch", F.lit(0)))
    store.extend(r.filter(F.col("role") != "user").withColumn("batch", F.lit(1)), ["conv_id"])
    return store.read().select("conv_id", "response_idx", "turn", F.md5("response").alias("text_md5"))


@register("c8_resumed_scoring", sql=SQL_LUQ + """SELECT conv_id,
  round(CASE WHEN count(confidence) = count(*) THEN avg(1 - confidence) END, 6) AS uncertainty FROM conf GROUP BY conv_id""")
def resumed_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 + J1: groups scored in flushes; the first call breaks off in its second flush, the next one scores the rest."""
    from ..operators import entailment as G

    r = FX.conv_responses(spark, sf_dir)
    store = SnapshotTable(spark, _scratch(spark, "luq-scores"), ["conv_id"], buckets=16)
    flush = max(1, -(-r.select("conv_id").distinct().count() // 3))
    calls = []

    def scorer(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError("between two flushes")
        return G.luq(ST.split_statements(rows, ["conv_id", "response_idx"]), rows, ["conv_id"])[1]

    try:
        SC.score_missing(r, ["conv_id"], scorer, store, flush)
    except InterruptedError:
        pass
    SC.score_missing(r, ["conv_id"], scorer, store, flush)
    return store.read().select("conv_id", F.round("uncertainty", 6).alias("uncertainty"))


@register("a18_a19_batch_roundtrip", sql="""
WITH e AS (SELECT p_name, min(p_partkey) AS "index" FROM part GROUP BY p_name),
r AS (SELECT "index", 'chat-completion-' || CAST(row_number() OVER (ORDER BY "index") - 1 AS VARCHAR) AS custom_id,
             'Write a few paragraphs on ''' || p_name || '''.' AS prompt FROM e)
SELECT "index", custom_id, 'stand-in-model' AS model, 2 AS n_messages, md5('echo: ' || prompt) AS text_md5,
       CAST(len(string_split(prompt, ' ')) AS INTEGER) AS n_logprobs FROM r""")
def batch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 (request JSONL, custom ids, pruned params) → stand-in result lines → A19 import by custom_id."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), F.col("p_partkey").alias("index"))
    e = P.keep_first(part, ["entity"], ["index"]).withColumn("prompt", P.entity_question(F.col("entity")))
    req = IO.batch_requests(e.select("index", "prompt"), ["index"], "stand-in-model", "Be accurate.",
                            {"temperature": 1.0, "max_tokens": 2048, "top_p": None})
    path = _scratch(spark, "batch")
    req.select("value").write.mode("overwrite").text(f"{path}/requests")
    lines = spark.read.text(f"{path}/requests")
    parsed = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"),
                          F.get_json_object("value", "$.body.model").alias("model"),
                          F.get_json_object("value", "$.body.messages[1].content").alias("prompt"),
                          F.size(F.from_json(F.get_json_object("value", "$.body.messages"), "array<string>")).alias("n_messages"))
    words = F.split(F.col("prompt"), " ")
    result = parsed.select(F.to_json(F.struct(
        F.col("custom_id"),
        F.struct(F.struct(F.array(F.struct(
            F.struct(F.concat(F.lit("echo: "), F.col("prompt")).alias("content")).alias("message"),
            F.struct(F.transform(words, lambda w: F.struct(w.alias("token"), (-F.length(w) / 10.0).alias("logprob"))).alias("content")).alias("logprobs"),
        )).alias("choices")).alias("body")).alias("response"))).alias("value"))
    result.write.mode("overwrite").text(f"{path}/results")
    res = spark.read.schema(IO.BATCH_RESULT).json(f"{path}/results")
    ids = req.select("index", "custom_id").join(parsed.select("custom_id", "model", "n_messages"), "custom_id")
    out = IO.import_batch_results(res, ids)
    return out.select("index", "custom_id", "model", "n_messages", F.md5("text").alias("text_md5"),
                      F.size("logprobs").alias("n_logprobs"))


@register("a20_atomic_claims", sql=f"""WITH {SQL_STATEMENTS_CTE},
rk AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos FROM conversations)
SELECT st.conv_id, rk.pos AS response_idx, st.statement_idx AS atom_idx, st.text AS atom
FROM st JOIN rk ON rk.conv_id = st.conv_id AND rk.turn = st.response_idx""")
def atomic_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decisions[[{{atom}}]] JSON (one document per group) → two posexplodes."""
    st = FX.conv_statements(spark, sf_dir)
    per_resp = st.groupBy("conv_id", "response_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("statement_idx", "text"))), lambda s: F.struct(s["text"].alias("atom"))).alias("atoms"))
    keys = FX.conv_responses(spark, sf_dir).select("conv_id", "response_idx")
    per_resp = keys.join(per_resp, ["conv_id", "response_idx"], "left").withColumn(
        "atoms", F.coalesce("atoms", F.array().cast("array<struct<atom:string>>")))
    doc = per_resp.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("response_idx", "atoms"))),
                                                      lambda x: x["atoms"]).alias("decisions"))
    path = _scratch(spark, "atoms")
    doc.write.mode("overwrite").json(path)
    schema = IO.ATOMS.add("conv_id", "long")
    back = spark.read.schema(schema).json(path)
    return IO.explode_atoms(back, ["conv_id"]).select("conv_id", F.col("response_idx").cast("int"),
                                                      F.col("atom_idx").cast("int"), "atom")


@register("a22_e13_job_result_scan", sql="""
SELECT event_type AS status, count(*) FILTER (WHERE event_type <> 'error') AS parsed,
       count(*) FILTER (WHERE event_type = 'error') AS corrupt,
       round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS avg_runtime
FROM events GROUP BY event_type""")
def job_result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory of JSON job results (crashed jobs leave truncated lines) read PERMISSIVE,
    with an E13-style summary per status."""
    ev = table(spark, sf_dir, "events")
    rec = F.to_json(F.struct(F.col("event_type").alias("metric"), F.lit("stand_in").alias("embedding_model"),
                             F.lit(10).alias("response_count"), F.lit("cpu").alias("device"),
                             F.lit("mean").alias("pooling"), F.col("value").alias("runtime_seconds"),
                             F.col("event_type").alias("status")))
    line = F.when(F.col("event_type") == "error", F.substring(rec, 1, 20)).otherwise(rec)
    path = _scratch(spark, "jobs")
    ev.select(line.alias("value"), "event_type").write.mode("overwrite").partitionBy("event_type").text(path)
    jobs = IO.read_job_results(spark, path)
    return jobs.groupBy(F.col("event_type").alias("status")).agg(
        F.count("metric").alias("parsed"), F.count("_corrupt_record").alias("corrupt"),
        F.round(F.avg("runtime_seconds"), 6).alias("avg_runtime"))


@register("a23_log_scan", sql="""
SELECT event_type AS kind, 'txt' AS type, CAST(sum(length('INFO  job ' || event_id || ' kind=' || event_type) + 1) AS BIGINT) AS bytes,
       count(*) AS lines, bool_or(event_type = 'error') AS has_error
FROM events GROUP BY event_type""")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files scanned for byte size, type and error keywords (one folder per kind)."""
    ev = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO "))
    path = _scratch(spark, "logs")
    ev.select(F.concat(level, F.lit(" job "), F.col("event_id").cast("string"), F.lit(" kind="), F.col("event_type")).alias("value"),
              F.col("event_type").alias("kind")).write.mode("overwrite").partitionBy("kind").option("compression", "none").text(path)
    scan = IO.scan_logs(spark, path, by=["kind"])
    return scan.groupBy("kind", "type").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.max("has_error").alias("has_error"))


@register("i1_i2_parameter_grid", sql="""
WITH runs AS (SELECT r.r_name AS block, list('org/' || lower(replace(n.n_name, '_', '-')) ORDER BY n.n_nationkey) AS models
              FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name),
g AS (SELECT block, unnest(['dispersion', 'luq']) AS metric, models FROM runs),
g2 AS (SELECT block, metric, unnest(models) AS model FROM g)
SELECT block, metric, model AS name, 'mean' AS pooling, replace(split_part(model, '/', -1), '-', '_') AS suffix,
       CAST(rc AS INTEGER) AS response_count
FROM g2, (SELECT unnest([125, 250, 375, 500]) AS rc)""")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I2: one run block per region; models = its nations (1-element specs) →
    grid of metric × model × response_count by explodes; specs normalised."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    runs = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))),
                    lambda x: F.array(F.concat(F.lit("org/"), F.lower(F.replace(x["n_name"], F.lit("_"), F.lit("-")))))).alias("model"))
    runs = runs.withColumn("metric", F.array(F.lit("dispersion"), F.lit("luq"))).withColumn(
        "response_count", F.array(*[F.lit(x) for x in (125, 250, 375, 500)]))
    g = S.parameter_grid(runs, ["metric", "model", "response_count"])
    spec = S.model_spec(F.col("model"))
    return g.select("block", "metric", spec["name"].alias("name"), spec["pooling"].alias("pooling"),
                    spec["suffix"].alias("suffix"), F.col("response_count").cast("int"))


SWEEP_LENGTHS = [25, 50, 100, 500]


@register("f12_truncation_sweep", sql=f"""WITH {SQL_STATEMENTS_CTE},
L AS (SELECT unnest({SWEEP_LENGTHS}) AS response_count),
w AS (SELECT st.*, L.response_count,
             coalesce(sum(len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) OVER (
                 PARTITION BY conv_id, response_idx, L.response_count ORDER BY statement_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st, L),
kept AS (SELECT conv_id, response_idx, response_count, count(*) AS n_kept, string_agg(text, ' ' ORDER BY statement_idx) AS joined
         FROM w WHERE before < response_count GROUP BY ALL),
keys AS (SELECT DISTINCT conv_id, response_idx, response_count FROM st, L)
SELECT k.conv_id, k.response_idx, CAST(k.response_count AS INTEGER) AS response_count, coalesce(n_kept, 0) AS n_kept,
       md5(CASE WHEN coalesce(joined, '') LIKE '%.' OR coalesce(joined, '') LIKE '%!' THEN coalesce(joined, '')
                ELSE coalesce(joined, '') || '.' END) AS truncated_md5
FROM keys k LEFT JOIN kept USING (conv_id, response_idx, response_count)""")
def truncation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 (D12/D13 part): every response truncated at four lengths in one job."""
    t = S.truncation_sweep(FX.conv_statements(spark, sf_dir), FX.RESP, SWEEP_LENGTHS)
    return t.select(*FX.RESP, F.col("response_count").cast("int"), "n_kept", F.md5("truncated").alias("truncated_md5"))


@register("f11_f12_dispersion_sweep")
def dispersion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 + F12: dispersion per (conversation, truncation length) of hashed-token embeddings."""
    d = S.dispersion_sweep(FX.conv_statements(spark, sf_dir), ["conv_id"], "response_idx", SWEEP_LENGTHS)
    return d.select("conv_id", "response_count", "k", *_r6("dispersion", "dispersion_norm"))


SQL_SUBSET_2 = """sub AS (SELECT conv_id, turn, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5('5|' || conv_id || '|' || turn), turn) <= 4)"""
SQL_SUBSET_METRICS = (f"WITH RECURSIVE {SQL_SUBSET_2}, " + f"{SQL_STATEMENTS_CTE}, {SQL_PAIRS}, {SQL_CLUSTERS}".replace("FROM conversations", "FROM sub") + f""",
rr AS (SELECT conv_id, CAST(turn AS INTEGER) AS j, list_distinct({sql_tokens('text')}) AS rt FROM sub),
k AS (SELECT conv_id, count(*) AS k FROM sub GROUP BY conv_id),
sij AS (SELECT st.conv_id, st.response_idx AS i, rr.j, avg({sql_containment(sql_tokens('st.text'), 'rr.rt')}) AS s
        FROM st JOIN rr ON st.conv_id = rr.conv_id AND st.response_idx <> rr.j GROUP BY ALL),
ssum AS (SELECT conv_id, i, sum(s) AS s FROM sij GROUP BY ALL),
conf AS (SELECT c.conv_id, c.turn, CASE WHEN k.k > 1 THEN ssum.s / (k.k - 1) END AS confidence
         FROM sub c JOIN k USING (conv_id) LEFT JOIN ssum ON ssum.conv_id = c.conv_id AND ssum.i = c.turn),
cnt AS (SELECT conv_id, cluster_id, count(*) AS n FROM ids GROUP BY ALL),
pc AS (SELECT conv_id, n * 1.0 / sum(n) OVER (PARTITION BY conv_id) AS p FROM cnt),
rs AS (SELECT conv_id, i, sum(exp(p_contra) / (exp(p_contra) + exp(p_entail))) AS s FROM pr GROUP BY ALL),
sn AS (SELECT c.conv_id, (coalesce(rs.s, 0) + 1 / (1 + exp(1))) / k.k AS s FROM sub c JOIN k USING (conv_id) LEFT JOIN rs ON rs.conv_id = c.conv_id AND rs.i = c.turn),
es AS (SELECT conv_id, sum(p_entail) AS s FROM pr GROUP BY conv_id),
v AS (
  SELECT conv_id, 'luq' AS metric, 'uncertainty' AS name, CAST(NULL AS BIGINT) AS item,
         CASE WHEN count(confidence) = count(*) THEN avg(1 - confidence) END AS value FROM conf GROUP BY conv_id
  UNION ALL SELECT conv_id, 'luq', 'confidence', CAST(turn AS BIGINT), confidence FROM conf
  UNION ALL SELECT conv_id, 'entailment', 'semantic_entropy', NULL, -sum(p * ln(p)) FROM pc GROUP BY conv_id
  UNION ALL SELECT conv_id, 'entailment', 'n_clusters', NULL, count(*) FROM pc GROUP BY conv_id
  UNION ALL SELECT conv_id, 'entailment', 'u_nli', NULL, avg(1 - s) FROM sn GROUP BY conv_id
  UNION ALL SELECT k.conv_id, 'entailment', 'u_deg', NULL, 1 - (k.k + coalesce(es.s, 0)) / (k.k * k.k) FROM k LEFT JOIN es USING (conv_id))
SELECT v.conv_id, metric, name, item, round(CAST(value AS DOUBLE), 6) + 0.0 AS value, x.subset_idx
FROM v JOIN (SELECT conv_id, list(CAST(turn AS INTEGER) ORDER BY turn) AS subset_idx FROM sub GROUP BY conv_id) x USING (conv_id)""")


@register("i6_metric_values", sql=SQL_SUBSET_METRICS)
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LUQ and the entailment values by name, over a seeded four of each conversation's turns."""
    r = FX.conv_responses(spark, sf_dir).select(*FX.RESP, "response")
    out = SC.score("luq", r, ["conv_id"], subset=4, seed=5).unionByName(
        SC.score("entailment", r, ["conv_id"], subset=4, seed=5).filter(F.col("name").isin("semantic_entropy", "n_clusters", "u_nli", "u_deg")))
    return out.select("conv_id", "metric", "name", "item", (F.round("value", 6) + 0.0).alias("value"), "subset_idx")


@register("i6_metric_dispatch")
def metric_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four metrics by name, from texts cut to 50 words, in the long metrics form."""
    r = FX.conv_responses(spark, sf_dir).select(
        *FX.RESP, "response", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("entity"))
    return SC.scores(SC.METRICS, r, ["conv_id"], response_count=50, subset=4, seed=5)


@register("e5_a13_scored_group_roundtrip", sql=f"""WITH {SQL_STATEMENTS_CTE},
pos AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS response_idx FROM conversations),
s AS (SELECT st.conv_id, pos.response_idx, st.statement_idx, st.text, length(st.text) % 2 = 0 AS even, length(st.text) AS n FROM st JOIN pos ON pos.conv_id = st.conv_id AND pos.turn = st.response_idx)
SELECT 'statement' AS kind, conv_id AS "index", response_idx, statement_idx AS i, text AS a, CASE WHEN even THEN 'True' ELSE 'False' END AS b,
       round(-n / 100.0, 6) AS x, round(1.0 / (1 + n), 6) AS y FROM s
UNION ALL SELECT 'label', conv_id, response_idx, m.s, m.model, string_agg(CAST(even = (m.s = 0) AS VARCHAR), ',' ORDER BY statement_idx), NULL, NULL
FROM s, (SELECT unnest(['judge_a', 'judge_b']) AS model, unnest([[0, 1], [0, 1]]) AS ss) mm, LATERAL (SELECT mm.model, unnest(mm.ss) AS s) m GROUP BY ALL
UNION ALL SELECT 'response', conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER), NULL, md5(text), role, NULL, NULL FROM conversations""")
def scored_group_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 (groups → responses → statements, sampled labels) appended in two writes (A13), read with the
    published schema and flattened again."""
    r = FX.conv_responses(spark, sf_dir)
    key = F.col("conv_id").alias("index")
    responses = r.select(key, F.lit("conv").alias("idx_cat"), "response_idx", "response",
                         F.transform(TX.tokens(F.col("response")), lambda t: -F.length(t) / 10.0).alias("logprobs"))
    st = FX.conv_statements(spark, sf_dir)
    n = F.length("text")
    even = n % 2 == 0
    statements = st.select(key, F.lit("conv").alias("idx_cat"), "response_idx", "statement_idx", "text", F.when(even, "True").otherwise("False").alias("class"),
                           (-n / 100.0).alias("logprob_raw"), (1.0 / (1 + n)).alias("prob_norm"), F.create_map(F.lit("1"), 1.0 / (1 + n)).alias("top_probs"))
    tall = st.groupBy("conv_id", "response_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("statement_idx", even.alias("e")))), lambda x: x["e"]).alias("e"))
    fan = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("sample_idx")) for m in ("judge_a", "judge_b") for s in (0, 1)]))
    labels = tall.select(key, F.lit("conv").alias("idx_cat"), "response_idx", "e", fan.alias("t")).select(
        "index", "idx_cat", "response_idx", "t.model", "t.sample_idx", F.when(F.col("t.sample_idx") == 0, F.col("e")).otherwise(F.transform("e", lambda v: ~v)).alias("labels"))
    groups = r.select(key, F.lit("conv").alias("idx_cat")).distinct().select("index", "idx_cat", F.concat(F.lit("conversation "), F.col("index").cast("string")).alias("entity"),
                                                                            F.lit(0).cast("long").alias("entity_page_idx"))
    nested = IO.assemble_scored_groups(groups, responses, statements, labels).withColumn("extra", F.lit("dropped by the projection"))
    path = _scratch(spark, "scored")
    IO.write_scored_groups(nested.filter("index % 2 = 0"), path)
    IO.write_scored_groups(nested.filter("index % 2 = 1"), path)
    back, stm, lab = IO.flatten_scored_groups(IO.read_groups(spark, path, IO.SCORED_GROUP))
    none = F.lit(None).cast("double")
    roles = r.select(F.col("conv_id").alias("index"), "role", F.md5("response").alias("a"))
    out = stm.select(F.lit("statement").alias("kind"), "index", "response_idx", F.col("statement_idx").alias("i"), F.col("text").alias("a"), F.col("class").alias("b"),
                     F.round("logprob_raw", 6).alias("x"), F.round(F.col("top_probs")["1"], 6).alias("y"))
    out = out.unionByName(lab.select(F.lit("label").alias("kind"), "index", "response_idx", F.col("sample_idx").alias("i"), F.col("model").alias("a"),
                                     F.array_join(F.transform("labels", lambda v: v.cast("string")), ",").alias("b"), none.alias("x"), none.alias("y")))
    known = back.select("index", "response_idx", F.md5("response").alias("a"))
    return out.unionByName(known.join(roles.distinct(), ["index", "a"]).select(F.lit("response").alias("kind"), "index", "response_idx", F.lit(None).cast("int").alias("i"), "a",
                                                                              F.col("role").alias("b"), none.alias("x"), none.alias("y")))


ARRIVALS = 3   # files, and so micro-batches, that the streamed tables are split into


@register("j1_incremental_moments", sql=_F7_SQL)
def incremental_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel moments kept by a streaming aggregation of additive Gram cells; the source is
    written as several files, each a micro-batch; equals the batch result."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", "embedding")
    src = _scratch(spark, "arrivals")
    emb.repartition(ARRIVALS, "vec_id").write.parquet(src)
    state = J.run_incremental_spectra(spark, src, emb.schema, ["label"], "vec_id", "embedding", work_dir=_scratch(spark, "stream"))
    s = J.latest_spectra(spark, state, ["label"])
    cols = ["trace", "fro2", "mean_cos", "purity", "renyi2"]
    return s.select("label", "k", *_r6(*cols))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), F.col("p_partkey").alias("index"))
    e = P.keep_first(part, ["entity"], ["index"])
    return e.select("index", P.generation_prompt(P.entity_question(F.col("entity")), 500).alias("prompt"))


@register("k1_k7_dry_run_generation", sql="""
WITH e AS (SELECT p_name, min(p_partkey) AS "index" FROM part GROUP BY p_name)
SELECT "index", 'Dry run answer: Write a few paragraphs on ''' || p_name || '''.' AS body FROM e""")
def dry_run_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K7 + D6: batch generation with the deterministic dry-run model (temperature 0),
    response body extracted between the tags."""
    g = K.generate(_prompts(spark, sf_dir), K.dry_run_generator, {"temperature": 0.0})
    return g.select("index", ST.response_body(F.col("text"))["body"].alias("body"))


@register("k2_k3_generation_retries", sql="""
SELECT min(p_partkey) AS "index", 'ok' AS status FROM part GROUP BY p_name""")
def generation_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + K3: invalid outputs (missing closing tag) are retried at temperature 0."""
    ok, failed = K.generate_with_retries(_prompts(spark, sf_dir), ["index"], K.dry_run_generator,
                                         F.col("text").contains("</response>"))
    return ok.select("index", F.lit("ok").alias("status")).unionByName(failed.select("index", F.col("reason").alias("status")))


@register("k1_durable_calls", sql="""
WITH e AS (SELECT p_name, min(p_partkey) AS "index" FROM part GROUP BY p_name)
SELECT "index", 'Dry run answer: Write a few paragraphs on ''' || p_name || '''.' AS body FROM e""")
def durable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 with answers that are kept per batch: the second run calls nothing (its model would raise), it reads the answers."""
    def no_model(pdf):
        raise RuntimeError("called again")

    prompts, folder = _prompts(spark, sf_dir), _scratch(spark, "answers")
    cut_lineage(K.generate_durable(prompts, ["index"], K.dry_run_generator, folder, 20_000, {"temperature": 0.0}))
    g = K.generate_durable(prompts, ["index"], no_model, folder, 20_000, {"temperature": 0.0})
    return g.select("index", ST.response_body(F.col("text"))["body"].alias("body"))


def _flaky_judge(pdf):
    """The stand-in judge; a call holding a second sample of judge_b on every seventh prompt raises."""
    if any(m == "judge_b" and s == 2 and K._digest(p) % 7 == 0 for p, m, s in zip(pdf["prompt"], pdf["model"], pdf["sample_idx"])):
        raise RuntimeError("judge not available")
    return K.dry_run_judge(pdf)


@register("k4_multi_judge_labels", sql=f"""WITH {SQL_STATEMENTS_CTE},
ln AS (SELECT *, (statement_idx + 1) || '. <statement>' || text || '</statement>' AS line FROM st),
pr AS (SELECT conv_id, response_idx, string_agg(line, chr(10) ORDER BY statement_idx) AS prompt FROM ln GROUP BY ALL),
smp AS (SELECT ln.conv_id, ln.response_idx, ln.statement_idx, m.model, s.s,
               CAST('0x' || substr(md5(m.model || '|' || s.s || '|' || ln.line), 1, 8) AS BIGINT) % 2 = 0 AS label
        FROM ln JOIN pr USING (conv_id, response_idx), (SELECT unnest(['judge_a', 'judge_b']) AS model) m, (SELECT unnest([0, 1, 2]) AS s) s
        WHERE NOT (m.model = 'judge_b' AND s.s = 2 AND CAST('0x' || substr(md5(pr.prompt), 1, 8) AS BIGINT) % 7 = 0))
SELECT conv_id, response_idx, statement_idx, round(avg(CAST(label AS DOUBLE)), 6) AS p_true, count(*) AS n_votes,
       avg(CAST(label AS DOUBLE)) >= 0.5 AS majority FROM smp GROUP BY ALL""")
def multi_judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 → D5 → E3 → E6: two stand-in judges × 3 samples label every response's statements; some calls fail."""
    from ..operators import labels as E

    st = FX.conv_statements(spark, sf_dir)
    per = st.groupBy(*FX.RESP).agg(F.array_sort(F.collect_list(F.struct("statement_idx", "text"))).alias("s"),
                                   F.count(F.lit(1)).alias("n_statements"))
    per = per.select(*FX.RESP, "n_statements", P.numbered_statements(F.transform("s", lambda x: x["text"])).alias("prompt"))
    lab = cut_lineage(K.label_samples(per, FX.RESP, ["judge_a", "judge_b"], 3, _flaky_judge))  # calls are made once
    long, lengths = K.sample_table(lab, FX.RESP)
    kept, _status = E.length_consensus(long, per.select(*FX.RESP, "n_statements"), FX.RESP, lengths)
    t = E.statement_truth(kept, FX.RESP)
    return t.select(*FX.RESP, "statement_idx", *_r6("p_true"), "n_votes", "majority")


@register("j1_incremental_luq", sql=SQL_LUQ + """SELECT conv_id,
  round(CASE WHEN count(confidence) = count(*) THEN avg(1 - confidence) END, 6) AS uncertainty FROM conf GROUP BY conv_id""")
def incremental_luq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 (LUQ): turns streamed in; touched conversations rescored and upserted per micro-batch."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    src = _scratch(spark, "arrivals")
    conv.repartition(ARRIVALS, "turn").write.parquet(src)
    res = J.run_incremental_luq(spark, src, conv.schema, ["conv_id"], "turn", "text", buckets=16, work_dir=_scratch(spark, "luq-stream"))
    return J.latest_luq(spark, res, ["conv_id"]).select("conv_id", F.round("uncertainty", 6).alias("uncertainty"))
