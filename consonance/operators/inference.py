"""Inference surface (K family): generation, retries, multi-judge labelling.

Models are user callables applied to Arrow batches inside ``mapInPandas``:
``generate_fn(pd.DataFrame with 'prompt' and per-pass params) -> pd.DataFrame
with 'text' and 'logprobs'`` and ``judge_fn(pd.DataFrame with 'prompt', 'model',
'sample_idx') -> pd.Series of answer texts``. The stand-ins below are
deterministic dry-run functions so that plans run offline.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import cut_lineage
from . import statements as ST

GEN_SCHEMA = "text string, logprobs array<double>"
CLOSING_PASSES = 4   # default number of passes after the first


def generate(prompts: DataFrame, generate_fn, params: dict | None = None) -> DataFrame:
    """K1: apply a batch generator to a prompt table; adds ``text``, ``logprobs`` and ``error``.

    A batch whose call raises is tried again prompt by prompt; a prompt that raises gets a null
    text and the error's message, so one bad prompt costs neither its batch nor the job.
    """
    params = params or {}
    in_cols = prompts.columns
    schema = T.StructType(prompts.schema.fields + [T.StructField("text", T.StringType()),
                                                    T.StructField("logprobs", T.ArrayType(T.DoubleType())),
                                                    T.StructField("error", T.StringType())])

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        out = generate_fn(pdf.assign(**params))
        return pd.DataFrame({"text": out["text"].to_numpy(), "logprobs": list(out["logprobs"]), "error": None})

    def run(batches):
        for pdf in batches:
            rows = pdf[in_cols].reset_index(drop=True)
            out = _call_by_row(call, pdf, lambda e: pd.DataFrame({"text": [None], "logprobs": [None], "error": [e]}))
            yield pd.concat([rows, out], axis=1)

    return prompts.mapInPandas(run, schema=schema)


def _call_by_row(call, pdf: pd.DataFrame, failed) -> pd.DataFrame:
    """``call`` on the whole batch or, where that raises, on each row alone (``failed(message)`` for a row that raises)."""
    try:
        return call(pdf).reset_index(drop=True)
    except Exception:  # noqa: BLE001 - user code may raise anything
        parts = []
        for i in range(len(pdf)):
            try:
                parts.append(call(pdf.iloc[i: i + 1].reset_index(drop=True)))
            except Exception as e:  # noqa: BLE001
                parts.append(failed(f"{type(e).__name__}: {e}"))
        return pd.concat(parts, ignore_index=True)


def _answers_file(folder: str, batch: pd.DataFrame, key_cols: list[str], params: dict):
    """The file system and path of a batch's answers, named by its keys, prompts and parameters."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
    said = repr([tuple(map(str, r)) for r in batch[[*key_cols, "prompt"]].itertuples(index=False)]) + repr(sorted(params.items()))
    return store, inner, f"{inner}/{hashlib.sha256(said.encode('utf-8')).hexdigest()}.parquet"


def generate_durable(prompts: DataFrame, key_cols: list[str], generate_fn, folder: str, batch_tokens: int,
                     params: dict | None = None, cost: Column | None = None) -> DataFrame:
    """K1 with answers that outlive the task: every batch's answers are written to ``folder`` (shared) as soon as the call
    returns, and a batch whose answers are there is not called again, whether a task is retried, an executor
    lost, or the whole job started anew.

    Batches hold prompts whose estimated tokens (``cost``, D10 by default) come to about ``batch_tokens``; which prompts
    share a batch follows from their keys alone, so a rerun makes the same batches. ``key_cols`` must be unique. A
    file appears under its name only when it is whole; of two attempts at one batch the first stays. A call that fails as a whole is tried prompt by
    prompt (as ``generate``); prompts that raise are answered with their error, and are called again by the next run.
    """
    params = params or {}
    schema = T.StructType(prompts.schema.fields + [T.StructField("text", T.StringType()), T.StructField("logprobs", T.ArrayType(T.DoubleType())),
                                                    T.StructField("error", T.StringType())])
    in_cols = prompts.columns
    tokens = cost if cost is not None else TX.token_estimate(F.col("prompt"))
    total = prompts.agg(F.coalesce(F.sum(tokens), F.lit(0.0)).cast("double")).first()[0]
    batches = max(1, round(total / batch_tokens))
    numbered = prompts.withColumn("_batch", F.pmod(F.xxhash64(*key_cols), F.lit(batches)))
    parts = min(batches, int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = numbered.repartition(parts, "_batch").sortWithinPartitions("_batch", *key_cols)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        out = generate_fn(pdf.assign(**params))
        return pd.DataFrame({"text": out["text"].to_numpy(), "logprobs": list(out["logprobs"]), "error": None})

    def answered(batch: pd.DataFrame) -> pd.DataFrame:
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        store, inner, path = _answers_file(folder, batch, key_cols, params)
        rows = batch[in_cols].reset_index(drop=True)
        if store.get_file_info(path).is_file:
            with store.open_input_file(path) as f:
                old = pq.read_table(f).to_pandas()
        else:
            old = pd.DataFrame({"text": [None] * len(rows), "logprobs": [None] * len(rows), "error": ["not called"] * len(rows)})
        todo = old["error"].notna().to_numpy()
        if todo.any():
            new = _call_by_row(call, rows[todo].reset_index(drop=True), lambda e: pd.DataFrame({"text": [None], "logprobs": [None], "error": [e]}))
            old = old.astype(object)
            old.loc[todo] = new.astype(object).to_numpy()
            answers = pa.schema([("text", pa.string()), ("logprobs", pa.list_(pa.float64())), ("error", pa.string())])
            store.create_dir(inner, recursive=True)
            own = f"{inner}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                pq.write_table(pa.Table.from_pandas(old, schema=answers, preserve_index=False), f)
            if store.get_file_info(path).is_file:
                store.delete_file(path)
            store.move(own, path)
        return pd.concat([rows, old.reset_index(drop=True)], axis=1)

    def run(frames):
        carry = None
        for pdf in frames:
            pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf["_batch"] == pdf["_batch"].iloc[-1]
            carry = pdf[last]
            for _, batch in pdf[~last].groupby("_batch", sort=False):
                yield answered(batch)
        if carry is not None and len(carry):
            yield answered(carry)

    return dealt.mapInPandas(run, schema=schema)


def generate_with_retries(prompts: DataFrame, key_cols: list[str], generate_fn, is_valid,
                          passes: list[dict] | None = None, folder: str | None = None, batch_tokens: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """K2 + K3: failed prompts are generated again (later passes may change parameters,
    e.g. temperature 0); after the last of ``passes`` the rest is quarantined
    (all failures are kept, not only the last pass's). ``is_valid`` is a Column; a prompt
    whose call raised is not valid.

    Each pass is checkpointed to the shared folder so the plan does not grow with passes. With ``folder``, answers
    outlive tasks and runs (``generate_durable``): only prompts without a kept answer are called.
    """
    passes = passes or [{}] + [{"temperature": 0.0}] * CLOSING_PASSES
    done = None
    todo = prompts
    for n, params in enumerate(passes):
        ok = F.coalesce(is_valid, F.lit(False)) & F.col("error").isNull()
        called = generate(todo, generate_fn, params) if folder is None else generate_durable(
            todo, key_cols, generate_fn, f"{folder}/pass={n}", batch_tokens, params)
        out = cut_lineage(called.withColumn("_ok", ok))
        good = out.filter("_ok").drop("_ok", "error")
        done = good if done is None else done.unionByName(good)
        todo = cut_lineage(todo.join(good.select(*key_cols), key_cols, "left_anti"))
        if todo.limit(1).count() == 0:
            break
    failed = todo.withColumn("reason", F.lit("generation failed after retries"))
    return done, failed


def label_samples(statements: DataFrame, key_cols: list[str], models: list[str], n_samples: int,
                  judge_fn) -> DataFrame:
    """K4: every response is labelled by every judge model ``n_samples`` times.

    ``statements``: ``key…, prompt, n_statements``. Fan-out is an ``explode`` of
    the (models × samples) list per row; a call that raises gives that one sample no labels.
    Returns ``key…, model, sample_idx, labels array<boolean>, error`` (parsed by D5), a row for
    every sample, also empty ones: ``sample_table`` turns it into E3's inputs.
    """
    fan = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("sample_idx"))
                              for m in models for s in range(n_samples)]))
    tasks = statements.select(*key_cols, "prompt", fan.alias("t")).select(
        *key_cols, "prompt", F.col("t.model").alias("model"), F.col("t.sample_idx").alias("sample_idx"))
    schema = T.StructType(tasks.schema.fields + [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"answer": np.asarray(judge_fn(pdf), dtype=object), "error": None})

    def run(batches):
        for pdf in batches:
            out = _call_by_row(call, pdf, lambda e: pd.DataFrame({"answer": [""], "error": [e]}))
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)

    out = tasks.mapInPandas(run, schema=schema)
    return out.select(*key_cols, "model", "sample_idx", ST.parse_label_list(F.coalesce("answer", F.lit(""))).alias("labels"), "error")


def sample_table(labelled: DataFrame, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """K4's output as E3's inputs: (labels in long form, length of every sample, 0 for empty ones)."""
    k = [*key_cols, "model", "sample_idx"]
    long = labelled.select(*k, F.posexplode("labels").alias("statement_idx", "label"))
    return long, labelled.select(*k, F.size("labels").cast("long").alias("len"))


# ---------------------------------------------------------------- deterministic stand-ins (K7)

def _digest(s: str) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


def dry_run_generator(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers '<response> Dry run answer: {question} </response>'; a prompt whose digest is
    odd 'forgets' the closing tag unless temperature is 0 (exercises K2/K3)."""
    temp = pdf["temperature"] if "temperature" in pdf else pd.Series([1.0] * len(pdf))
    texts, lps = [], []
    for p, t in zip(pdf["prompt"], temp):
        body = "Dry run answer: " + p.split("<question>")[-1].split("</question>")[0]
        broken = (_digest(p) % 2 == 1) and t != 0.0
        texts.append("<response> " + body + ("" if broken else " </response>"))
        lps.append([-0.4] * 5)
    return pd.DataFrame({"text": texts, "logprobs": lps})


def dry_run_judge(pdf: pd.DataFrame) -> pd.Series:
    """Numbered 'n. True/False' answers; statement k is True when the digest of
    (model, sample, prompt line k) is even."""
    out = []
    for prompt, model, s in zip(pdf["prompt"], pdf["model"], pdf["sample_idx"]):
        lines = [ln for ln in prompt.split("\n") if ln.strip()]
        out.append("\n".join(f"{k + 1}. {'True' if _digest(f'{model}|{s}|{ln}') % 2 == 0 else 'False'}"
                             for k, ln in enumerate(lines)))
    return pd.Series(out)
