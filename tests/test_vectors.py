import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.operators import vectors as V


def _df(spark, groups):
    rows = [(g, i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, i int, v array<double>")


def _spectra(spark, groups, operator=V.group_spectra):
    out = operator(_df(spark, groups), ["g"], "v").collect()
    return {r["g"]: r for r in out}


def test_identical_rows_score_near_zero(spark):
    # MF-SAME: eigenvalues (4.001, .001, .001, .001)/4
    r = _spectra(spark, {"same": [[1, 0, 0]] * 4})["same"]
    p = np.array([4.001, 0.001, 0.001, 0.001]) / 4
    assert r["dispersion"] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-9)
    assert r["mean_cos"] == pytest.approx(1.0)


def test_orthonormal_rows(spark):
    # MF-ORTH: each eigenvalue 1.001/4 -> -1.001 ln(0.25025)
    r = _spectra(spark, {"orth": np.eye(4).tolist()})["orth"]
    assert r["dispersion"] == pytest.approx(-1.001 * np.log(0.25025), abs=1e-9)
    assert r["dispersion_norm"] == pytest.approx(-1.001 * np.log(0.25025) / np.log(4), abs=1e-9)
    assert r["mean_cos"] == pytest.approx(0.0, abs=1e-12)


def test_direct_equals_gram_path_and_reference_formula(spark):
    rng = np.random.default_rng(3)
    groups = {"small": rng.normal(size=(5, 8)).tolist(), "big": rng.normal(size=(30, 8)).tolist()}
    a = _spectra(spark, groups)
    b = _spectra(spark, groups, V.group_spectra_gram)
    for g, x in groups.items():
        x = np.array(x)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = u @ u.T + np.eye(len(x)) * 1e-3
        p = np.linalg.eigvalsh(z) / len(x)
        ref = -(p * np.log(p)).sum()
        c = x @ (np.eye(x.shape[1]) - 1 / x.shape[1]) @ x.T
        es = np.linalg.slogdet(c + 1e-3 * np.eye(len(x)))[1] / len(x)
        for r in (a[g], b[g]):
            assert r["dispersion"] == pytest.approx(ref, abs=1e-9)
            assert r["eigenscore"] == pytest.approx(es, abs=1e-8)
            assert r["fro2"] == pytest.approx(float(((u @ u.T) ** 2).sum()), abs=1e-9)
            assert r["trace"] == pytest.approx(len(x))


def test_permutation_invariance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 4))
    a = _spectra(spark, {"g": x.tolist()})["g"]["dispersion"]
    b = _spectra(spark, {"g": x[::-1].tolist()})["g"]["dispersion"]
    assert a == pytest.approx(b, abs=1e-12)


def test_zero_vectors_are_quarantined(spark):
    df = _df(spark, {"g": [[0, 0], [1, 0], [0, 1]]})
    good, bad = V.normalize_rows(df, "v")
    assert good.count() == 2 and bad.count() == 1
    assert bad.first()["reason"].startswith("zero")


def test_cosine_and_pooling(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], 1), (1, 1, [0.0, 2.0], 1), (1, 2, [9.0, 9.0], 0)],
                               "k int, pos int, v array<double>, m int")
    mean = V.pool_tokens(df, ["k"], "pos", "v", "m", "mean").first()["pooled"]
    assert mean == [0.5, 1.0]
    assert V.pool_tokens(df, ["k"], "pos", "v", "m", "max").first()["pooled"] == [1.0, 2.0]
    assert V.pool_tokens(df, ["k"], "pos", "v", "m", "last").first()["pooled"] == [0.0, 2.0]
    c = spark.range(1).select(V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first()["c"]
    assert c == pytest.approx(2 ** -0.5)


def test_groups_straddling_arrow_batches(spark):
    rng = np.random.default_rng(12)
    groups = {f"g{j}": rng.normal(size=(int(rng.integers(1, 9)), 5)).tolist() for j in range(40)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = _spectra(spark, groups)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    b = _spectra(spark, groups, V.group_spectra_gram)
    assert a.keys() == b.keys() == groups.keys()
    for g in groups:
        assert a[g]["k"] == len(groups[g])
        assert a[g]["dispersion"] == pytest.approx(b[g]["dispersion"], abs=1e-9)
        assert a[g]["eigenscore"] == pytest.approx(b[g]["eigenscore"], abs=1e-8)


def test_flagship_direct_equals_gram_path_on_table(spark):
    from conftest import SF_SMALL
    from consonance.plans.dispersion_plans import dispersion_by_label, dispersion_gram, eigenscore_by_label

    a = {r["label"]: r for r in dispersion_by_label(spark, SF_SMALL).collect()}
    b = {r["label"]: r for r in dispersion_gram(spark, SF_SMALL).collect()}
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert a[k]["k"] == b[k]["k"]
        assert a[k]["dispersion"] == pytest.approx(b[k]["dispersion"], abs=1e-8)
        # 0 ≤ normalised dispersion ≲ 1 (jitter makes it slightly larger than ln K at most)
        assert 0 <= a[k]["dispersion_norm"] <= 1.01
    assert all(r["eigenscore"] is not None for r in eigenscore_by_label(spark, SF_SMALL).collect())


def test_infinite_vectors_are_rejected(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, None)], "k int, v array<double>")
    good, bad = V.normalize_rows(df, "v")
    assert [r["k"] for r in good.collect()] == [1] and sorted(r["k"] for r in bad.collect()) == [2, 3, 4, 5]


def test_wide_form_equals_the_others(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(g, (r.normal(size=40) + 2 * r.normal(size=1)).tolist()) for g, n in (("one", 1), ("few", 7), ("many", 333), (None, 60)) for _ in range(n)]
    rows += [("copies", rows[20][1])] * 150
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(5)
    names = ["k", "dispersion", "eigenscore", "trace", "fro2", "mean_cos", "purity", "renyi2"]
    want = {x["g"]: x for x in V.group_spectra(df, ["g"], "v").collect()}
    for chunk in (None, 50, 16):
        got = {x["g"]: x for x in V.group_spectra_wide(df, ["g"], "v", chunk_rows=chunk).collect()}
        assert got.keys() == want.keys()
        for g, x in got.items():
            for n in names:
                assert x[n] == (None if want[g][n] is None else pytest.approx(want[g][n], abs=1e-8, rel=1e-8)), (g, n)
    assert V.group_spectra_wide(df.limit(0), ["g"], "v").count() == 0


def test_model_width_in_tiles(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(2, 1536))
    rows = [(g, (base[g] + 0.5 * r.normal(size=1536)).tolist()) for g in (0, 1) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(4)
    want = {x["g"]: x["dispersion"] for x in V.group_spectra(df, ["g"], "v").collect()}
    got = {x["g"]: x["dispersion"] for x in V.group_spectra_wide(df, ["g"], "v", chunk_rows=60).collect()}
    assert got == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("method", ["mean", "max"])
def test_pooling_in_batches(spark, method, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(k, i, r.normal(size=6).tolist(), int(r.random() < 0.8)) for k, n in ((1, 700), (2, 3), (None, 5), (3, 1)) for i in range(n)]
    rows += [(3, 9, None, 1)]
    df = spark.createDataFrame(rows, "k long, pos int, v array<double>, mask int").repartition(7)
    monkeypatch.setattr(V, "POOL_BYTES", 64)
    got = {x["k"]: x["pooled"] for x in V.pool_tokens(df, ["k"], "pos", "v", "mask", method).collect()}
    want = {}
    for k in (1, 2, None, 3):
        x = [v for kk, _, v, m in rows if kk == k and m and v is not None]
        if x:
            want[k] = (np.mean if method == "mean" else np.max)(x, axis=0)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k].tolist(), abs=1e-12)
    plan = V.pool_tokens(df, ["k"], "pos", "v", "mask", method)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_small_groups_leave_no_cells_and_no_tiles(spark, monkeypatch):
    """A group whose Grams are whole in one task is finished there; only larger groups hand cells or tiles on."""
    rng = np.random.default_rng(5)
    rows = [(g, [float(v) for v in rng.normal(size=4)]) for g, k in (("a", 5), (None, 3), ("b", 1), ("big", 90)) for _ in range(k)]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    handed = {}
    for name in ("sum_cells", "_merged"):
        def spy(partial, cols, *rest, name=name, fn=getattr(V, name)):
            handed[name] = {x["g"] for x in partial.select("g").distinct().collect()}
            return fn(partial, cols, *rest)
        monkeypatch.setattr(V, name, spy)
    want = {x["g"]: x for x in V.group_spectra(df, ["g"], "v").collect()}
    for form in (V.group_spectra_gram(df, ["g"], "v"), V.group_spectra_wide(df, ["g"], "v", chunk_rows=2)):
        got = {x["g"]: x for x in form.collect()}
        assert got.keys() == want.keys()
        for g, x in got.items():
            for n in ("k", "dispersion", "eigenscore", "trace", "fro2", "mean_cos", "renyi2"):
                assert (x[n] is None and want[g][n] is None) or abs(x[n] - want[g][n]) < 1e-8, (g, n)
    assert handed == {"sum_cells": {"big"}, "_merged": {"big"}}
