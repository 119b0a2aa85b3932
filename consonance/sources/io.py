"""Sources and sinks (A family): group files, prompt tables, result stores, batch-inference
files, job-result and log directories. Readers take explicit schemas (no inference);
writers go through Spark's commit protocol (staging + atomic job commit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE = T.StructType([T.StructField("response", T.StringType()),
                         T.StructField("logprobs", T.ArrayType(T.DoubleType()))])
GROUP = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("idx_cat", T.StringType()),
    T.StructField("entity", T.StringType()), T.StructField("responses", T.ArrayType(RESPONSE)),
])
# Scored groups (fixed field names): what the labelling and sampled-scoring steps publish.
STATEMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("class", T.StringType()),
                          T.StructField("logprob_raw", T.DoubleType()), T.StructField("prob_norm", T.DoubleType()),
                          T.StructField("top_probs", T.MapType(T.StringType(), T.DoubleType()))])
SCORED_RESPONSE = T.StructType([*RESPONSE.fields, T.StructField("statements", T.ArrayType(STATEMENT)),
                                T.StructField("sampled_labels", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.BooleanType()))))])
SCORED_GROUP = T.StructType([*GROUP.fields[:3], T.StructField("entity_page_idx", T.LongType()),
                             T.StructField("responses", T.ArrayType(SCORED_RESPONSE))])
GROUP_KEY = ["index", "idx_cat"]
PROMPTS = T.StructType([T.StructField("index", T.LongType()), T.StructField("idx_cat", T.StringType()),
                        T.StructField("answer", T.StringType()), T.StructField("open_ended_question", T.StringType())])
# Positional names of the headerless book-summary TSV (fixed values).
BOOK_TSV = T.StructType([T.StructField(n, T.StringType()) for n in
                         ["wiki_art_id", "freebase_id", "title", "author", "pub_date", "genres", "plot"]])
ATOMS = T.StructType([T.StructField("decisions", T.ArrayType(T.ArrayType(
    T.StructType([T.StructField("atom", T.StringType())]))))])
JOB_RESULT = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("embedding_model", T.StringType()),
    T.StructField("response_count", T.IntegerType()), T.StructField("device", T.StringType()),
    T.StructField("pooling", T.StringType()), T.StructField("runtime_seconds", T.DoubleType()),
    T.StructField("start_time", T.StringType()), T.StructField("end_time", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("results", T.StructType([T.StructField("score", T.DoubleType()),
                                           T.StructField("variance", T.DoubleType()),
                                           T.StructField("samples_processed", T.IntegerType())])),
    T.StructField("_corrupt_record", T.StringType()),
])
ERROR_KEYWORDS = "(?i)(error|exception|traceback|failed)"
# Fixed values of the batch-inference request lines.
CUSTOM_ID_PREFIX = "chat-completion-"
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"


def read_groups(spark: SparkSession, path: str, schema: T.StructType = GROUP, multiline: bool = False) -> DataFrame:
    """A1 (one JSON array document, ``multiline=True``) / A2 (JSON lines)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def assemble_scored_groups(groups: DataFrame, responses: DataFrame, statements: DataFrame, labels: DataFrame) -> DataFrame:
    """E5: groups → responses → statements and sampled labels as SCORED_GROUP rows.

    ``groups``: index, idx_cat, entity, entity_page_idx; ``responses``: key…, response_idx, response, logprobs;
    ``statements``: key…, response_idx, statement_idx and STATEMENT's fields; ``labels``: key…, response_idx,
    model, sample_idx, labels. A row holds one question's responses, as the published form does;
    missing statements and labels are empty, and a group without responses keeps an empty list.
    """
    k, r = GROUP_KEY, [*GROUP_KEY, "response_idx"]
    in_order = lambda col, by, value: F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda x: x["v"]).alias(col)
    st = statements.groupBy(*r).agg(in_order("statements", "statement_idx", F.struct(*[F.to_json(f).alias(f) if f == "top_probs" else F.col(f) for f in STATEMENT.names])))
    per_model = labels.groupBy(*r, "model").agg(in_order("samples", "sample_idx", F.col("labels")))
    lb = per_model.groupBy(*r).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "samples")))).alias("sampled_labels"))
    full = responses.join(st, r, "left").join(lb, r, "left")
    # maps cannot be compared, so they travel through the sorts as JSON
    packed = F.struct("response", "logprobs", F.coalesce("statements", F.array()).alias("statements"), F.to_json(
        F.coalesce("sampled_labels", F.create_map().cast(SCORED_RESPONSE["sampled_labels"].dataType))).alias("sampled_labels"))
    nested = full.groupBy(*k).agg(in_order("rs", "response_idx", packed))
    tops, samples = STATEMENT["top_probs"].dataType.simpleString(), SCORED_RESPONSE["sampled_labels"].dataType.simpleString()
    statement = lambda s: F.struct(*[F.from_json(s[f], tops).alias(f) if f == "top_probs" else s[f].alias(f) for f in STATEMENT.names])
    response = lambda x: F.struct(x["response"].alias("response"), x["logprobs"].alias("logprobs"),
                                  F.transform(x["statements"], statement).alias("statements"), F.from_json(x["sampled_labels"], samples).alias("sampled_labels"))
    out = groups.join(nested, k, "left").select(*k, "entity", "entity_page_idx", F.transform("rs", response).alias("responses"))
    return out.select("index", "idx_cat", "entity", "entity_page_idx", F.coalesce("responses", F.array()).alias("responses"))


def write_scored_groups(groups: DataFrame, path: str) -> None:
    """Append, projected to SCORED_GROUP's fields."""
    append_projected(groups, SCORED_GROUP.names).write.mode("append").json(path)


def flatten_scored_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SCORED_GROUP rows as long tables: responses, statements, sampled labels (one row per sample)."""
    r = groups.select(*GROUP_KEY, "entity", F.posexplode("responses").alias("response_idx", "r"))
    key = [*GROUP_KEY, "response_idx"]
    statements = r.select(*key, F.posexplode("r.statements").alias("statement_idx", "s")).select(*key, "statement_idx", "s.*")
    labels = r.select(*key, F.explode("r.sampled_labels").alias("model", "samples")).select(*key, "model", F.posexplode("samples").alias("sample_idx", "labels"))
    return r.select(*key, "entity", "r.response", "r.logprobs"), statements, labels


def write_with_rejects(df: DataFrame, ok, reason: str, path: str) -> None:
    """Valid rows under ``path``/side=data, the others with their reason under ``path``/side=failed,
    both from one evaluation of ``df``."""
    flagged = df.withColumn("reason", F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(reason)))
    flagged.withColumn("side", F.when(F.col("reason").isNull(), "data").otherwise("failed")).write.mode("append").partitionBy("side").json(path)


def read_prompts(spark: SparkSession, path: str, schema: T.StructType = PROMPTS) -> DataFrame:
    """A4: prompt CSV with a header."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_book_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A5: headerless TSV with seven positional names."""
    return spark.read.schema(BOOK_TSV).option("sep", "\t").option("header", False).csv(path)


def read_entity_list(spark: SparkSession, path: str) -> DataFrame:
    """One entity per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("entity")).filter(F.col("entity") != "")


def read_splits(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """``{split: glob}`` → one frame with a ``split`` column."""
    out = None
    for split, path in paths.items():
        part = spark.read.format(fmt).load(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_metrics(df: DataFrame, path: str, partition_cols: list[str] = ("metric", "model", "response_count")) -> None:
    """A3 + A11: metrics table as Parquet, partitioned; a rerun replaces only the partitions
    it writes (dynamic partition overwrite; the job commit is atomic per partition)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def upsert_latest(existing: DataFrame, new: DataFrame, key_cols: list[str], order_col: str) -> DataFrame:
    """Union and keep the last write per key (highest ``order_col``; a null is lowest, and
    of equal ones a row of ``new`` wins, then the row whose content hashes higher)."""
    u = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in existing.columns if c not in key_cols]
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col), "_new", F.xxhash64(F.to_json(F.struct(*others))))
    g = u.groupBy(*key_cols).agg(F.max_by(F.struct(*others), rank).alias("_v"))
    return g.select(*key_cols, *[F.col(f"_v.{c}").alias(c) for c in others])


def append_projected(df: DataFrame, fields: list[str]) -> DataFrame:
    """Project to the fixed field list before an append."""
    return df.select(*fields)


def merge_extend(existing: DataFrame, new: DataFrame, key_cols: list[str], idx_col: str = "response_idx",
                 batch_col: str = "batch") -> DataFrame:
    """A key's new responses extend its existing list; indices renumbered in
    (batch, previous index) order. The renumbering never sorts a whole key in one task
    (a key may hold a large share of the rows): see ``prep.number_within_groups``."""
    from ..operators.prep import number_within_groups

    u = existing.unionByName(new)
    return number_within_groups(u, key_cols, [batch_col, idx_col], "_rn").withColumn(
        idx_col, F.col("_rn").cast("int")).drop("_rn")


def flatten_export(groups: DataFrame, topic_col: str) -> DataFrame:
    """One (topic, output) line per response."""
    return groups.select(F.col(topic_col).alias("topic"), F.explode("responses").alias("r")).select(
        "topic", F.col("r.response").alias("output"))


def batch_requests(prompts: DataFrame, order_cols: list[str], model: str, system: str,
                   params: dict | None = None) -> DataFrame:
    """One JSON request line per prompt; ``custom_id = chat-completion-{i}`` with a dense
    0-based i in ``order_cols`` order; sampling parameters with null values are pruned."""
    from ..operators.prep import dense_index

    idx = dense_index(prompts, order_cols, "_i")
    kept = {k: v for k, v in (params or {}).items() if v is not None}
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                            F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
                    *[F.lit(v).alias(k) for k, v in kept.items()])
    cid = F.concat(F.lit(CUSTOM_ID_PREFIX), F.col("_i").cast("string"))
    return idx.select(*order_cols, cid.alias("custom_id"),
                      F.to_json(F.struct(cid.alias("custom_id"), F.lit(REQUEST_METHOD).alias("method"),
                                         F.lit(REQUEST_URL).alias("url"), body.alias("body"))).alias("value"))


BATCH_RESULT = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([
            T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
            T.StructField("logprobs", T.StructType([T.StructField("content", T.ArrayType(T.StructType([
                T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())])))])),
        ])))]))])),
])


def import_batch_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Text and token logprobs from result lines, matched to requests by ``custom_id``."""
    ch = F.element_at("response.body.choices", 1)
    r = results.select("custom_id", ch["message"]["content"].alias("text"),
                       F.transform(ch["logprobs"]["content"], lambda t: t["logprob"]).alias("logprobs"))
    return requests.join(r, "custom_id", "left")


def explode_atoms(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """``decisions[response][atom]`` → one row per atomic claim with both positions."""
    a = df.select(*key_cols, F.posexplode("decisions").alias("response_idx", "atoms"))
    return a.select(*key_cols, "response_idx", F.posexplode("atoms").alias("atom_idx", "a")).select(
        *key_cols, "response_idx", "atom_idx", F.col("a.atom").alias("atom"))


def write_csv(df: DataFrame, path: str) -> None:
    """Tabular CSV sink with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_job_results(spark: SparkSession, path: str) -> DataFrame:
    """A directory of JSON job results; malformed lines kept in ``_corrupt_record``."""
    return (spark.read.schema(JOB_RESULT).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def scan_logs(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """Per log file: size in bytes, stream (stdout or stderr by the file's name), the job it
    belongs to (the name without stream and extension) and whether any line has an error keyword.
    ``by`` names partition columns of the folder to keep."""
    by = by or []
    lines = spark.read.text(path).select(*by, "_metadata.file_path", "_metadata.file_name", "_metadata.file_size", "value")
    per = lines.groupBy(*by, "file_path", F.col("file_name").alias("file"), F.col("file_size").alias("bytes")).agg(
        F.count(F.lit(1)).alias("lines"), F.max(F.col("value").rlike(ERROR_KEYWORDS).cast("int")).alias("_err"))
    stem = F.regexp_replace("file", "\\.[A-Za-z0-9]+$", "")
    stream = F.regexp_extract(stem, "(stdout|stderr)", 1)
    return per.select(*by, "file", F.when(stream != "", stream).alias("stream"), F.regexp_replace(stem, "[._-]*(stdout|stderr)", "").alias("job"),
                      F.regexp_extract("file", "\\.([A-Za-z0-9]+)$", 1).alias("type"), "bytes", "lines", (F.col("_err") == 1).alias("has_error"))


def lookup_last(df: DataFrame, key_cols: list[str], value_col: str, order_col: str) -> DataFrame:
    """Key → value table where a repeated key keeps its last row (highest ``order_col``)."""
    return df.groupBy(*key_cols).agg(F.max_by(value_col, order_col).alias(value_col))


def write_json_array_documents(df: DataFrame, path: str, n_files: int | None = None) -> None:
    """A1 sink: every output file is one JSON array document (``[ {...}, {...} ]``).

    Each partition streams its rows in order and frames them – '[' before the first,
    ',' between, ']' after the last – so no group set is ever gathered; one file per
    partition (``n_files`` repartitions first).
    """
    import pandas as pd

    js = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j"))
    if n_files:
        js = js.repartition(n_files)

    def frame(batches):
        prev, opened = None, False
        for pdf in batches:
            out = []
            for v in pdf["j"].tolist():
                if prev is not None:
                    out.append(("" if opened else "[") + prev + ",")
                    opened = True
                prev = v
            if out:
                yield pd.DataFrame({"value": out})
        if prev is not None:
            yield pd.DataFrame({"value": [("" if opened else "[") + prev + "]"]})

    js.mapInPandas(frame, schema="value string").write.mode("overwrite").text(path)
