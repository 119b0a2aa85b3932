import json
import os
import tempfile

import numpy as np
import pytest

from consonance.operators import vectors as V
from consonance.sources import io as IO


def test_multiline_json_groups(spark):
    d = tempfile.mkdtemp(prefix="consonance-a1-")
    doc = [{"index": 1, "idx_cat": "train", "entity": "E", "responses": [{"response": "a", "logprobs": [-0.1]},
                                                                         {"response": "b", "logprobs": []}]},
           {"index": 2, "idx_cat": "val", "entity": "F", "responses": []}]
    with open(os.path.join(d, "groups.json"), "w") as f:
        json.dump(doc, f, indent=2)
    g = IO.read_groups(spark, d, multiline=True)
    rows = sorted(g.collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == [1, 2]
    assert [x["response"] for x in rows[0]["responses"]] == ["a", "b"]


def test_gram_form_matches_direct_on_a_hot_group(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(f"g{j}", i, rng.normal(size=6).tolist()) for j in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    routed = {r["g"]: r for r in V.group_spectra_gram(df, ["g"], "v").collect()}
    direct = {r["g"]: r for r in V.group_spectra(df, ["g"], "v").collect()}
    assert routed.keys() == direct.keys()
    for g in direct:
        assert routed[g]["k"] == direct[g]["k"]
        for c in ("dispersion", "eigenscore", "fro2", "mean_cos"):
            assert routed[g][c] == pytest.approx(direct[g][c], abs=1e-9)


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 2)], "k int, v string, t int")
    up = {r["k"]: r["v"] for r in IO.upsert_latest(old, new, ["k"], "t").collect()}
    assert up == {1: "c", 2: "b"}
    tied = spark.createDataFrame([(1, "d", 1), (2, "e", None), (3, "f", None)], "k int, v string, t int")
    up = {r["k"]: r["v"] for r in IO.upsert_latest(old, tied, ["k"], "t").collect()}
    assert up == {1: "d", 2: "b", 3: "f"}  # of equal ones the new row, a null order is lowest


def test_additive_sweep_equals_embedding_truncated_text(spark):
    from pyspark.sql import functions as F

    from consonance.functions import embed as EM
    from consonance.operators import statements as ST
    from consonance.operators import sweep as S

    resp = spark.createDataFrame([(1, 0, "Alpha beta gamma. Delta epsilon!\nZeta eta theta iota."),
                                  (1, 1, "One two. Three four five six seven.")], "g int, r int, response string")
    st = ST.split_statements(resp, ["g", "r"])
    a = {(x["g"], x["r"], x["response_count"]): x["vec"] for x in S.additive_sweep_embeddings(st, ["g", "r"], [1, 3, 6, 50]).collect()}
    t = S.truncation_sweep(st, ["g", "r"], [1, 3, 6, 50]).select("g", "r", "response_count", EM.hashed_embedding(F.col("truncated")).alias("vec"))
    b = {(x["g"], x["r"], x["response_count"]): x["vec"] for x in t.collect()}
    assert a == b


def test_json_array_document_sink_round_trip(spark):
    import glob

    df = spark.createDataFrame([(i, f"t{i}") for i in range(23)], "k int, v string")
    d = tempfile.mkdtemp(prefix="consonance-a1w-") + "/out"
    IO.write_json_array_documents(df, d, n_files=3)
    for f in glob.glob(d + "/part-*"):
        if os.path.getsize(f):
            assert isinstance(json.load(open(f)), list)
    back = spark.read.schema("k int, v string").option("multiLine", True).json(d)
    assert sorted(tuple(r) for r in back.collect()) == [(i, f"t{i}") for i in range(23)]
