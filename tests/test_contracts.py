"""Error contracts: unknown names raise instead of silently producing output."""

import pytest

from consonance.operators import entailment as G
from consonance.operators import scoring as SC
from consonance.operators import sweep as S
from consonance.operators import vectors as V


def test_unknown_names_raise(spark):
    df = spark.createDataFrame([("g", 0, 0, -1.0)], "g string, cluster_id int, i int, ll double")
    with pytest.raises(ValueError):
        SC.score("no_such_metric", None, [])
    with pytest.raises(ValueError):
        G.logsumexp_by_cluster(df, ["g"], "cluster_id", "ll", agg="median")
    pairs = spark.createDataFrame([("g", 0, 1, 0.1, 0.2, 0.7), ("g", 1, 0, 0.1, 0.2, 0.7)],
                                  "g string, i int, j int, p_contra double, p_neutral double, p_entail double")
    with pytest.raises(ValueError):
        G.entailment_graph(pairs, ["g"], weighted=True, weight_strategy="other")
    tok = spark.createDataFrame([(1, 0, [1.0])], "k int, pos int, v array<double>")
    with pytest.raises(ValueError):
        V.pool_tokens(tok, ["k"], "pos", "v", method="median")


def test_logsumexp_modes(spark):
    import math

    df = spark.createDataFrame([("g", 0, math.log(0.2)), ("g", 0, math.log(0.3)), ("g", 1, math.log(0.5))],
                               "g string, cluster_id int, ll double")
    got = {m: {r["cluster_id"]: r["value"] for r in G.logsumexp_by_cluster(df, ["g"], "cluster_id", "ll", agg=m).collect()}
           for m in ("sum", "mean", "sum_normalized")}
    assert got["sum"][0] == pytest.approx(math.log(0.5) - 5.0)
    assert got["mean"][0] == pytest.approx(math.log(0.25))
    assert got["sum_normalized"][1] == pytest.approx(math.log(0.5))


def test_metrics_by_name_from_texts(spark):
    rows = [("q", i, "a topic", t) for i, t in enumerate(["Cats sleep. Cats eat fish.", "Cats sleep a lot.", "Dogs bark.", "Cats eat fish. Dogs bark."])]
    df = spark.createDataFrame(rows, "g string, response_idx int, entity string, response string")
    for metric in SC.METRICS:
        out = SC.score(metric, df, ["g"], response_count=20, subset=3, seed=1)
        assert out.columns == ["g", "metric", "name", "item", "value", "subset_idx"]
        got = out.collect()
        assert got and {r["metric"] for r in got} == {metric} and all(len(r["subset_idx"]) == 3 for r in got)
    tables = SC.entailment_tables(df, ["g"])
    assert tables["pairs"].count() == 12 and tables["ids"].count() == 4 and tables["laplacian"].count() >= 4
    assert tables["metrics"].count() == 2 + 1 + 1 + 130
    vec = SC.embedded(df, ["g"]).first()["vec"]
    plain = SC.embedded(df.drop("entity"), ["g"]).first()["vec"]
    assert sum(vec) > sum(plain)  # the header's words are embedded too


def test_grids_take_scalars_and_specs_take_strings(spark):
    runs = spark.createDataFrame([("b", "luq", [1, 2], "org/a-b")], "block string, metric string, n array<int>, model string")
    g = S.parameter_grid(runs, ["metric", "n"])
    assert sorted((r["metric"], r["n"]) for r in g.collect()) == [("luq", 1), ("luq", 2)]
    spec = runs.select(S.model_spec(S.spec_list(runs, "model")).alias("s")).first()["s"]
    assert (spec["name"], spec["pooling"], spec["suffix"]) == ("org/a-b", "mean", "a_b")


def test_rejects_are_written_beside_the_data(spark, tmp_path):
    from pyspark.sql import functions as F

    from consonance.sources import io as IO

    df = spark.createDataFrame([(1, "ok"), (2, None), (3, "")], "k int, t string")
    IO.write_with_rejects(df, F.length("t") > 0, "empty text", str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r["k"], r["side"], r["reason"]) for r in back.select("k", "side", "reason").collect()} == {(1, "data", None), (2, "failed", "empty text"), (3, "failed", "empty text")}


def test_responses_are_chosen_and_cut_once_per_metric(spark):
    r = spark.createDataFrame([(1, i, f"one red car. number {i}") for i in range(4)], "conv_id long, response_idx int, response string")
    for metric in SC.METRICS:
        out = SC.score(metric, r, ["conv_id"], response_count=3, subset=2, seed=5)
        assert "_salt#" not in out._jdf.queryExecution().optimizedPlan().toString(), metric
        assert {tuple(x["subset_idx"]) for x in out.collect()} and out.filter("size(subset_idx) <> 2").isEmpty()


def test_metrics_of_one_call_share_their_responses(spark, monkeypatch):
    calls, whole = [], SC.prepared
    monkeypatch.setattr(SC, "prepared", lambda *a, **k: calls.append(a) or whole(*a, **k))
    r = spark.createDataFrame([(i, f"one two. three {i}. four") for i in range(4)], "response_idx int, response string").selectExpr("7 AS conv_id", "*")
    options = {"response_count": 3, "subset": 2, "seed": 5}
    both = SC.scores(("luq", "graph_uncertainty"), r, ["conv_id"], **options)
    assert len(calls) == 1
    apart = SC.score("luq", r, ["conv_id"], **options).unionByName(SC.score("graph_uncertainty", r, ["conv_id"], **options))
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
