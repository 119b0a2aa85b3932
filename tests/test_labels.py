from consonance.operators import labels as E


def _samples(spark, lengths, n_statements):
    rows = [("r", "m", s, k, True) for s, n in enumerate(lengths) for k in range(n)]
    samples = spark.createDataFrame(rows, "key string, model string, sample_idx int, statement_idx int, label boolean")
    n = spark.createDataFrame([("r", n_statements)], "key string, n_statements long")
    return samples, n


def test_length_consensus_cases(spark):
    # MF-LEN: 3,3,2 with 3 statements keeps two; 2,2,3 is flagged; 2,2,2 passes with length_ok false
    kept, st = E.length_consensus(*_samples(spark, [3, 3, 2], 3), ["key"])
    assert sorted({r["sample_idx"] for r in kept.collect()}) == [0, 1]
    assert not st.first()["flagged"]
    kept, st = E.length_consensus(*_samples(spark, [2, 2, 3], 3), ["key"])
    assert st.first()["flagged"] and kept.count() == 0
    kept, st = E.length_consensus(*_samples(spark, [2, 2, 2], 3), ["key"])
    r = st.first()
    assert not r["flagged"] and not r["length_ok"] and kept.count() == 6


def test_empty_samples_count(spark):
    """Lengths 0, 0, 3 with three statements: the mode is 0, so the response is flagged; all empty passes without labels."""
    samples, n = _samples(spark, [0, 0, 3], 3)
    lens = lambda *x: spark.createDataFrame([("r", "m", s, v) for s, v in enumerate(x)], "key string, model string, sample_idx int, len long")
    kept, st = E.length_consensus(samples, n, ["key"], lens(0, 0, 3))
    assert st.first()["flagged"] and st.first()["mode_len"] == 0 and kept.count() == 0
    _kept, st = E.length_consensus(samples.limit(0), n, ["key"], lens(0, 0, 0))
    assert not st.first()["flagged"] and not st.first()["length_ok"]


def test_mode_tie_takes_smallest(spark):
    kept, st = E.length_consensus(*_samples(spark, [3, 2], 2), ["key"])
    assert st.first()["mode_len"] == 2 and not st.first()["flagged"]


def test_truth_and_entropy(spark):
    rows = [("r", "m", s, 0, v) for s, v in enumerate([True, True, False])]
    kept = spark.createDataFrame(rows, "key string, model string, sample_idx int, statement_idx int, label boolean")
    t = E.statement_truth(kept, ["key"]).first()
    assert abs(t["p_true"] - 2 / 3) < 1e-12 and t["majority"]
    df = spark.createDataFrame([("u", c) for c in "aabc"], "u string, c string")
    h = E.category_entropy(df, ["u"], "c").first()
    import math
    p = [0.5, 0.25, 0.25]
    assert abs(h["entropy"] - (-sum(x * math.log(x) for x in p))) < 1e-12
    assert abs(h["entropy_scaled"] - h["entropy"] / math.log(4)) < 1e-12


def test_one_flagged_response_fails_its_group(spark):
    status = spark.createDataFrame([("s1", "en", True), ("s1", "fr", False), ("s2", "en", False)],
                                   "source string, lang string, flagged boolean")
    ok, bad = E.split_by_group_flag(status, ["source"])
    assert sorted((r["source"], r["lang"]) for r in bad.collect()) == [("s1", "en"), ("s1", "fr")]
    assert {r["reason"] for r in bad.collect()} == {"sampled_labels_mismatch"}
    assert [(r["source"], r["lang"]) for r in ok.collect()] == [("s2", "en")]
