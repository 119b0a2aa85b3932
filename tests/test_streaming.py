import os
import tempfile

import pytest

from conftest import SF_SMALL
from consonance.plans.dispersion_plans import kernel_moments
from consonance.plans.result_plans import incremental_moments


def test_stream_equals_batch(spark):
    a = {r["label"]: r for r in kernel_moments(spark, SF_SMALL).collect()}
    b = {r["label"]: r for r in incremental_moments(spark, SF_SMALL).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["k"] == b[k]["k"]
        assert a[k]["fro2"] == pytest.approx(b[k]["fro2"], abs=2e-6)


def test_stream_folds_several_batches(spark):
    from pyspark.sql import functions as F

    from consonance.operators import vectors as V
    from consonance.streaming import incremental as J

    src = tempfile.mkdtemp(prefix="consonance-stream-src-")
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    emb.repartition(4).write.mode("overwrite").parquet(src + "/data")
    state = J.run_incremental_spectra(spark, src + "/data", emb.schema, ["label"], "vec_id", "embedding",
                                      work_dir=tempfile.mkdtemp(prefix="consonance-stream-"), max_files_per_trigger=1)
    got = {r["label"]: r["dispersion"] for r in J.latest_spectra(spark, state, ["label"]).collect()}
    good, _ = V.normalize_rows(emb, "embedding")
    want = {r["label"]: r["dispersion"] for r in V.group_spectra(good, ["label"], "embedding").collect()}
    table = J._cells(spark, state, ["label"])
    assert table.marks()["stream"] >= 3
    assert not table.append(table.read(), ("stream", 3))   # a micro-batch that is run again adds nothing
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_incremental_luq_over_several_batches(spark):
    from pyspark.sql import functions as F

    from consonance.operators import entailment as G
    from consonance.operators import statements as ST
    from consonance.streaming import incremental as J

    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    src = tempfile.mkdtemp(prefix="consonance-luq-src-")
    # turns arrive in four files: a conversation's turns are spread over several batches
    conv.withColumn("part", F.col("turn") % 4).write.partitionBy("part").parquet(src + "/in")
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(src + "/in") for f in fs if f.endswith(".parquet")]
    flat = src + "/flat"
    os.makedirs(flat)
    for n, f in enumerate(sorted(files)):
        os.link(f, os.path.join(flat, f"b{n:03d}.parquet"))
    res = J.run_incremental_luq(spark, flat, conv.schema, ["conv_id"], "turn", "text", buckets=8,
                                work_dir=tempfile.mkdtemp(prefix="consonance-luq-"))
    got = {r["conv_id"]: r["uncertainty"] for r in J.latest_luq(spark, res, ["conv_id"]).collect()}
    st = ST.split_statements(conv, ["conv_id", "turn"], "text")
    _, unc = G.luq(st, conv, ["conv_id"], "turn", "text")
    want = {r["conv_id"]: r["uncertainty"] for r in unc.collect()}
    assert got.keys() == want.keys()
    for k in want:
        if want[k] is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(want[k], abs=1e-12)


def _arrivals(spark, frames, src=None):
    """Each frame as one file, in order."""
    src = src or tempfile.mkdtemp(prefix="consonance-arrivals-")
    for f in frames:
        out = tempfile.mkdtemp(prefix="consonance-file-")
        f.coalesce(1).write.mode("overwrite").parquet(out)
        n = len(os.listdir(src))
        part = next(x for x in os.listdir(out) if x.endswith(".parquet"))
        os.rename(os.path.join(out, part), os.path.join(src, f"b{n:04d}.parquet"))
        os.utime(os.path.join(src, f"b{n:04d}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))
    return src


RESPONSES = "g string, i int, text string"


def _luq(spark, rows):
    from consonance.operators import entailment as G
    from consonance.operators import statements as ST

    df = spark.createDataFrame(rows, RESPONSES)
    return {r["g"]: r["uncertainty"] for r in G.luq(ST.split_statements(df, ["g", "i"], "text"), df, ["g"], "i", "text")[1].collect()}


def _close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k], abs=1e-9), k


def test_a_changed_text_takes_the_place_of_the_old_one(spark):
    from consonance.streaming import incremental as J

    first = [("a", 0, "The sky is blue. Grass is green."), ("a", 1, "The sky is grey. 3.5 is a number."), ("b", 0, "One."), ("b", 1, None), ("c", 0, "Alone."), ("d", 0, ""), ("d", 1, "x y")]
    second = [("a", 1, "The sky is blue."), ("a", 2, "!!! ... Grass is red\nand blue"), ("b", 1, "One two."), ("d", 0, "y"), ("a", 0, "The sky is blue. Grass is green.")]
    third = [("a", 2, None), ("b", 1, "Three."), ("d", 0, "x"), ("d", 0, "x y z")]
    state, src, work = {}, None, tempfile.mkdtemp(prefix="consonance-luq-")
    for rows in (first, second, third):
        src = _arrivals(spark, [spark.createDataFrame(rows, RESPONSES)], src)
        res = J.run_incremental_luq(spark, src, spark.createDataFrame([], RESPONSES).schema, ["g"], "i", "text", work_dir=work)
        for g, i, t in sorted(rows, key=lambda r: r[2] or ""):
            state[g, i] = t
        got = {r["g"]: r["uncertainty"] for r in J.latest_luq(spark, res, ["g"]).collect()}
        _close(got, _luq(spark, [(g, i, t) for (g, i), t in state.items()]))


def test_tables_of_sums_are_compacted(spark, monkeypatch):
    from consonance.streaming import incremental as J

    monkeypatch.setattr(J, "MAX_FOLDERS", 2)
    rows = [("a", i, f"word{i % 3} and word{i % 2}. Same here.") for i in range(7)]
    src = _arrivals(spark, [spark.createDataFrame([r], RESPONSES) for r in rows])
    res = J.run_incremental_luq(spark, src, spark.createDataFrame([], RESPONSES).schema, ["g"], "i", "text", work_dir=tempfile.mkdtemp(prefix="consonance-luq-"))
    table = J._sums(spark, res, ["g"], 16)
    m = table.manifest()
    assert m["marks"]["stream"] == 6 and all(len(f) <= 2 for f in m["folders"].values())
    _close({r["g"]: r["uncertainty"] for r in J.latest_luq(spark, res, ["g"]).collect()}, _luq(spark, rows))
    table.vacuum(keep=1)
    assert len(table._names("data")) <= 2 and len(table._names("manifests")) == 1
    _close({r["g"]: r["uncertainty"] for r in J.latest_luq(spark, res, ["g"]).collect()}, _luq(spark, rows))


def test_state_is_bounded_by_time(spark):
    """Vectors and responses that no longer may come again leave the state; one that does is counted again."""
    import time

    from consonance.streaming import incremental as J

    vec = "label int, vec_id long, embedding array<float>"
    rows = [spark.createDataFrame([(0, 100 * b + i, [1.0 * i, 1.0, float(b)]) for i in range(20)], vec) for b in range(3)]
    work, src, progress, sizes = tempfile.mkdtemp(prefix="consonance-moments-"), None, [], []
    for f in rows:
        src = _arrivals(spark, [f], src)
        seen: list = []
        cells = J.run_incremental_spectra(spark, src, f.schema, ["label"], "vec_id", "embedding", work_dir=work, horizon="1 second", progress=seen)
        sizes.append(J.state_rows(seen)[-1])
        progress += seen
        time.sleep(2)
    assert sum(p["numInputRows"] for p in progress) == 60 and max(sizes) <= 40 and sizes[-1] < 60
    assert J.latest_spectra(spark, cells, ["label"]).first()["k"] == 60

    work, src, sizes = tempfile.mkdtemp(prefix="consonance-luq-"), None, []
    for b in range(3):
        src = _arrivals(spark, [spark.createDataFrame([("g", 100 * b + i, f"text {i}.") for i in range(20)] + ([("g", 0, "text 0.")] if b == 2 else []), RESPONSES)], src)
        seen = []
        res = J.run_incremental_luq(spark, src, spark.createDataFrame([], RESPONSES).schema, ["g"], "i", "text", work_dir=work, ttl_ms=1000, progress=seen)
        sizes.append(J.state_rows(seen)[-1])
        time.sleep(2)
    assert sizes[-1] < 60
    k = J._sums(spark, res, ["g"], 16).read().agg({"k": "sum"}).first()[0]
    assert k == 61   # the late response counts as a further one
