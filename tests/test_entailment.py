import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.functions import text as TX
from consonance.operators import entailment as G


def _pairs(spark, m):
    """m: (K, K, 3) array [contra, neutral, entail]."""
    k = m.shape[0]
    rows = [("g", i, j, float(m[i, j, 0]), float(m[i, j, 1]), float(m[i, j, 2]))
            for i, j in itertools.product(range(k), range(k)) if i != j]
    pairs = spark.createDataFrame(rows, "g string, i int, j int, p_contra double, p_neutral double, p_entail double")
    items = spark.createDataFrame([("g", i) for i in range(k)], "g string, i int")
    return pairs, items


def _ids(spark, m, strict=False):
    pairs, items = _pairs(spark, m)
    return [r["cluster_id"] for r in G.semantic_ids(pairs, items, ["g"], strict=strict).orderBy("i").collect()]


E, N, C = [0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]


def test_overwrite_rule_later_head_wins(spark):
    # MF-OVERWRITE: 0~2, 1~2, 0 !~ 1  -> 0, 1, 1
    m = np.array([[E, C, E], [C, E, E], [E, E, E]])
    assert _ids(spark, m) == [0, 1, 1]


def test_equivalence_default_and_strict(spark):
    m = np.array([[E, N, E], [E, E, C], [N, C, E]])
    # default: (0,1): labels 1 and 2 -> equivalent; (0,2): 2 and 1 -> equivalent; (1,2): contradiction
    assert _ids(spark, m) == [0, 0, 0]
    assert _ids(spark, m, strict=True) == [0, 1, 2]


def defined_ids(m):
    """By definition: heads are items without an earlier equivalent head; an id is the rank of the
    latest earlier equivalent head, or of the item itself if it is a head."""
    label = m.argmax(axis=2)
    clash = (label == 0) | (label.T == 0) | ((label == 1) & (label.T == 1))
    heads: list[int] = []
    ids = []
    for item in range(len(m)):
        near = [rank for rank, head in enumerate(heads) if not clash[item, head]]
        if not near:
            heads.append(item)
        ids.append(near[-1] if near else len(heads) - 1)
    return ids


def test_fold_matches_the_definition_on_random_graphs(spark):
    rng = np.random.default_rng(0)
    rows, items, expect = [], [], {}
    for g in range(60):
        k = int(rng.integers(1, 7))
        lab = rng.integers(0, 3, size=(k, k))
        m = np.eye(3)[lab]
        for i in range(k):
            items.append((g, i))
            for j in range(k):
                if i != j:
                    rows.append((g, i, j, *map(float, m[i, j])))
        expect[g] = defined_ids(m)
    pairs = spark.createDataFrame(rows, "g int, i int, j int, p_contra double, p_neutral double, p_entail double")
    it = spark.createDataFrame(items, "g int, i int")
    for form in (G.semantic_ids, G.semantic_ids_rounds):
        got = {}
        for r in form(pairs, it, ["g"]).collect():
            got.setdefault(r["g"], {})[r["i"]] = r["cluster_id"]
        for g, ids in expect.items():
            assert [got[g][i] for i in range(len(ids))] == ids


def test_rounds_equal_the_fold_on_one_large_group(spark):
    rng = np.random.default_rng(1)
    n = 250
    both = [("g", i, j, *((2, 1.0, 2, 1.0) if rng.random() < 0.02 else (0, 1.0, 0, 1.0))) for i in range(n) for j in range(i + 1, n)]
    probs = lambda label: tuple(float(label == k) for k in range(3))
    rows = [(g, i, j, *probs(a), *probs(b)) for g, i, j, a, _, b, _ in both]
    pairs = spark.createDataFrame(rows, "g string, i int, j int, p_contra_ij double, p_neutral_ij double, p_entail_ij double, p_contra_ji double, p_neutral_ji double, p_entail_ji double")
    items = spark.createDataFrame([("g", i) for i in range(n)] + [("alone", 3)], "g string, i int")
    fold = {tuple(r) for r in G.semantic_ids(pairs, items, ["g"]).collect()}
    assert {tuple(r) for r in G.semantic_ids_rounds(pairs, items, ["g"]).collect()} == fold and len(fold) == n + 1
    assert G.semantic_ids_rounds(pairs, items.limit(0), ["g"]).count() == 0


def test_mf_nli3_degree_and_selfcheck(spark):
    m = np.array([[[0, 0, 1], [0.2, 0.3, 0.5], [0.6, 0.3, 0.1]],
                  [[0.1, 0.1, 0.8], [0, 0, 1], [0.3, 0.4, 0.3]],
                  [[0.5, 0.25, 0.25], [0.2, 0.2, 0.6], [0, 0, 1]]])
    pairs, items = _pairs(spark, m)
    e = m[:, :, 2]
    w = (e + e.T) / 2
    u_deg = np.trace(3 * np.eye(3) - np.diag(w.sum(axis=1))) / 9
    assert G.degree_uncertainty(pairs, items, ["g"]).first()["u_deg"] == pytest.approx(u_deg)
    pc = np.exp(m[:, :, 0]) / (np.exp(m[:, :, 0]) + np.exp(m[:, :, 2]))
    s, u = G.selfcheck(pairs, items, ["g"])
    assert u.first()["u_nli"] == pytest.approx(np.mean(1 - pc.mean(axis=1)))
    # Argmax with ties to the lowest index
    imp = {(r["i"], r["j"]): r["label"] for r in G.implication(pairs).collect()}
    assert imp[(1, 2)] == 1 and imp[(0, 2)] == 0 and imp[(2, 1)] == 2


def test_spectral_panel_shapes_and_ueigv(spark):
    m = np.array([[[0, 0, 1], [0.2, 0.3, 0.5], [0.6, 0.3, 0.1]],
                  [[0.1, 0.1, 0.8], [0, 0, 1], [0.3, 0.4, 0.3]],
                  [[0.5, 0.25, 0.25], [0.2, 0.2, 0.6], [0, 0, 1]]])
    pairs, items = _pairs(spark, m)
    out = {r["metric"]: r["value"] for r in G.spectral_panel(pairs, items, ["g"]).collect()}
    assert len(out) == 2 + 64 + 64
    e = m[:, :, 2]
    w = (e + e.T) / 2
    d = w.sum(axis=1)
    lap = np.eye(3) - w / np.sqrt(np.outer(d, d))
    assert out["u_eigv"] == pytest.approx(np.maximum(0, 1 - np.linalg.eigvalsh(lap)).sum())
    assert "heat_t=0.1_kernel_entropy_s" in out and "weighted_maternn_kappa=3.0_nu=3.0_kernel_entropy" in out


def test_luq_token_form_equals_pair_form(spark):
    from consonance.functions import text as TX
    from consonance.operators import statements as ST

    resp = spark.createDataFrame([(1, 0, "The cat sat. The dog ran."), (1, 1, "A cat ran fast. Birds fly."),
                                  (1, 2, "Dogs bark.\nCats sleep."), (2, 0, "Only one.")],
                                 "g int, response_idx int, response string")
    st = ST.split_statements(resp, ["g", "response_idx"])
    fast, ufast = G.luq(st, resp, ["g"])

    def scorer(stmt, response):
        return TX.containment(TX.tokens(stmt), F.array_distinct(TX.tokens(response)))

    slow, uslow = G.luq(st, resp, ["g"], scorer=scorer)
    a = {(r["g"], r["response_idx"]): r["confidence"] for r in fast.collect()}
    b = {(r["g"], r["response_idx"]): r["confidence"] for r in slow.collect()}
    assert a.keys() == b.keys()
    for k in a:
        if a[k] is None:
            assert b[k] is None
        else:
            assert a[k] == pytest.approx(b[k])
    assert a[(2, 0)] is None  # K = 1


def test_luq_of_paraphrased_statements(spark):
    """Statements that are no verbatim parts of their response: both forms agree, and S(i, j) gives the confidence."""
    from consonance.functions import text as TX

    resp = spark.createDataFrame([(1, 0, "red car"), (1, 1, "blue car"), (1, 2, "a red bus")], "g int, response_idx int, response string")
    st = spark.createDataFrame([(1, 0, 0, "blue car"), (1, 0, 1, "red"), (1, 1, 0, "green bus"), (1, 2, 0, "nothing here")],
                               "g int, response_idx int, statement_idx int, text string")

    def scorer(stmt, response):
        return TX.containment(TX.tokens(stmt), F.array_distinct(TX.tokens(response)))

    for form in (None, scorer):
        conf, _ = G.luq(st, resp, ["g"], scorer=form)
        got = {r["response_idx"]: r["confidence"] for r in conf.collect()}
        assert got == {0: pytest.approx(0.5), 1: pytest.approx(0.25), 2: pytest.approx(0.0)}
        s = {(r["i"], r["j"]): r["s"] for r in G.luq_similarity(st, resp, ["g"], scorer=form).collect()}
        assert s[(0, 1)] == pytest.approx(0.5) and s[(0, 2)] == pytest.approx(0.5) and s[(1, 2)] == pytest.approx(0.5) and len(s) == 6
        for i in range(3):
            assert sum(v for (a, _), v in s.items() if a == i) / 2 == pytest.approx(got[i])


def test_two_class_models_leave_the_rest_to_neutral(spark):
    r = spark.range(1).select(G.two_class_probs(F.lit(0.7), F.lit(0.2)).alias("p")).first()["p"]
    assert (r["p_contra"], r["p_entail"]) == (0.2, 0.7) and r["p_neutral"] == pytest.approx(0.1)


def test_features_of_statements_and_responses_are_made_before_they_are_paired(spark):
    st = spark.createDataFrame([("a", 0, 0, "Red car"), ("a", 1, 0, "")], "g string, response_idx int, statement_idx int, text string")
    r = spark.createDataFrame([("a", 0, "red"), ("a", 1, "the red red car"), ("a", 2, None)], "g string, response_idx int, response string")
    p = G.statement_entailment(st, r, ["g"], TX.containment, features=TX.token_set)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "split" not in plan.split("Join")[0]
    score = lambda s, t: TX.containment(TX.tokens(s), F.array_distinct(TX.tokens(t)))
    assert sorted(p.collect(), key=str) == sorted(G.statement_entailment(st, r, ["g"], score).collect(), key=str) and p.count() == 4
