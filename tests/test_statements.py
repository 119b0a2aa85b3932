import pytest
from pyspark.sql import functions as F

from consonance.operators import statements as ST


def test_tags_pairs_and_mismatch(spark):
    # MF-TAGS
    good_txt = "<statement> A. </statement><class>1</class>\n<statement>B</statement> <class>0</class>"
    bad_txt = "<statement>A</statement><class>1</class><statement>B</statement>"
    nl_txt = "<statement>A\nB</statement><class>1</class>"
    df = spark.createDataFrame([(1, good_txt), (2, bad_txt), (3, nl_txt)], "k int, t string")
    good, bad = ST.parse_tagged(df, ["k"], "t")
    rows = sorted((r["k"], r["statement_idx"], r["text"], r["class"]) for r in good.collect())
    assert rows == [(1, 0, "A.", True), (1, 1, "B", False)]
    assert sorted(r["k"] for r in bad.collect()) == [2]  # 3 has neither a pair nor a single-line tag


def test_class_tokens_and_probabilities(spark):
    # MF-TOKENS: <class> split over tokens, a stray '1' elsewhere, a missing alternative
    toks = ["<st", "atement>", "x 1", "</statement>", "<cl", "ass>", "1", "</cl", "ass>", "1",
            "<class>", "0", "</class>"]
    lps = [0.0] * len(toks)
    lps[6], lps[11] = -0.1, -0.2
    top = [{} for _ in toks]
    top[6] = {"1": -0.1, "0": -2.4}
    top[11] = {"0": 0.0}
    df = spark.createDataFrame([(1, toks, lps, top)], "k int, tokens array<string>, logprobs array<double>, top array<map<string,double>>")
    r = sorted(ST.class_token_probs(df, ["k"]).collect(), key=lambda x: x["statement_idx"])
    assert [x["pos"] for x in r] == [6, 11]
    import math
    p1, p0 = math.exp(-0.1), math.exp(-2.4)
    assert r[0]["prob_norm"] == pytest.approx(math.exp(-0.1) / (p0 + p1))
    assert r[1]["p0"] == pytest.approx(1.0) and r[1]["p1"] == 0.0
    assert r[1]["prob_norm"] == pytest.approx(math.exp(-0.2) / 1.0)


def test_truncation_budget_before_statement(spark):
    # MF-TRUNC: three 3-word statements; budgets 1, 4, 5 words keep 1, 2, 2
    st = spark.createDataFrame([(b, i, "aa bb cc.") for b in (1, 4, 5) for i in range(3)],
                               "budget int, statement_idx int, text string")
    for fn in (lambda s: ST.truncate_words(s, ["budget"], "budget"),
               lambda s: ST.truncate(s, ["budget"], F.col("budget"))):
        kept = fn(st).groupBy("budget").count().collect()
        assert {r["budget"]: r["count"] for r in kept} == {1: 1, 4: 2, 5: 2}
    rb = ST.rebuild_text(ST.truncate_words(st, ["budget"], "budget"), ["budget"]).collect()
    assert {r["budget"]: r["truncated"] for r in rb}[4] == "aa bb cc. aa bb cc."


def test_label_list_and_claim_list(spark):
    df = spark.createDataFrame([("1. True\n2.False\n3. maybe\n4. False",
                                 "x <new_claims>\n - a\n--b \n</new_claims>")], "a string, c string")
    r = df.select(ST.parse_label_list(F.col("a")).alias("l"), ST.parse_claim_list(F.col("c")).alias("c")).first()
    assert r["l"] == [True, False, False]
    assert r["c"] == [" a", "b"]  # per line only spaces are stripped, then leading dashes


def test_response_body(spark):
    df = spark.createDataFrame([("pre <response>  body text \n</response> post",)], "t string")
    b = df.select(ST.response_body(F.col("t")).alias("b")).first()["b"]
    assert b["body"] == "body text" and b["left_trim"] == "  " and b["right_trim"] == " \n"


def test_carriage_return_and_second_tag(spark):
    df = spark.createDataFrame([(1, "<statement>two\r x</statement> <class>1</class>")], "k int, t string")
    good, bad = ST.parse_tagged(df, ["k"], "t")
    assert [(r["text"], r["class"]) for r in good.collect()] == [("two\r x", True)] and bad.count() == 0
    b = spark.createDataFrame([("a <response> one <response> two </response>",)], "t string").select(ST.response_body(F.col("t"))["body"].alias("b")).first()
    assert b["b"] == "one"
