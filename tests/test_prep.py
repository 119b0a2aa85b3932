from pyspark.sql import functions as F

from consonance.operators import prep as P


def test_templates_and_entity_recovery(spark):
    df = spark.createDataFrame([("Ada Lovelace",)], "e string")
    r = df.select(P.entity_question(F.col("e")).alias("q")).select("q", P.entity_from_question(F.col("q")).alias("back")).first()
    assert r["q"] == "Write a few paragraphs on 'Ada Lovelace'."
    assert r["back"] == "Ada Lovelace"
    b = df.select(P.book_entity(F.lit("It's"), F.lit("O'Brien"), F.lit("March 5, 2001")).alias("x")).first()["x"]
    assert b == "Its written by OBrien in the year March 5, 2001"


def test_keep_first_and_dense_index(spark):
    df = spark.createDataFrame([(k % 7, k, f"v{k}") for k in range(200)], "g int, k int, v string")
    kf = {r["g"]: r["k"] for r in P.keep_first(df, ["g"], ["k"]).collect()}
    assert kf == {g: g for g in range(7)}
    idx = P.dense_index(df.select("k"), ["k"], n_parts=5).collect()
    assert sorted((r["k"], r["row_idx"]) for r in idx) == [(k, k) for k in range(200)]


def test_group_subset_matches_brute_force(spark):
    df = spark.createDataFrame([(g, i) for g in range(4) for i in range(50)], "g int, i int")
    a = P.group_subset(df, ["g"], "i", 5, seed=3, salts=8)
    h = df.withColumn("h", P.hash_order(["g", "i"], 3)).collect()
    want = set()
    for g in range(4):
        rows = sorted([r for r in h if r["g"] == g], key=lambda r: (r["h"], r["i"]))[:5]
        want |= {(g, r["i"]) for r in rows}
    assert {(r["g"], r["i"]) for r in a.collect()} == want


def test_flags_and_shortfall(spark):
    ents = spark.createDataFrame([("Paris",), ("john",), ("john smith",), ("Hamburg",), ("burg",)], "entity string")
    names = spark.createDataFrame([("John",)], "name string")
    places = spark.createDataFrame([("paris",)], "name string")
    f = {r["entity"]: (r["is_first_name"], r["is_ambiguous_place"]) for r in P.ambiguity_flags(ents, "entity", names, places).collect()}
    assert f == {"Paris": (False, True), "john": (True, False), "john smith": (False, False),
                 "Hamburg": (False, True), "burg": (False, False)}
    exp = spark.createDataFrame([(1, 3), (2, 3)], "k int, n int")
    have = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    s = P.shortfall(exp, have, ["k"], "n")
    assert sorted((r["k"], r["sample_idx"]) for r in s.collect()) == [(2, 0), (2, 1)]


def test_number_within_groups_with_a_hot_key(spark):
    import random

    rnd = random.Random(2)
    rows = [("hot", i, rnd.random()) for i in range(600)] + [(f"k{j}", i, rnd.random()) for j in range(30) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {(r["k"], r["i"]): r["rn"] for r in P.number_within_groups(df, ["k"], ["x", "i"], n_parts=7).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1]))):
            want[(k, r[1])] = n
    assert got == want


def test_numbering_with_payload_is_dense_at_any_partitioning(spark):
    """120,000 rows with a payload column: numbers are dense and rows are neither lost nor repeated."""
    from consonance.sources import io as IO

    n = 120_000
    rows = spark.range(n).select(F.col("id"), (F.xxhash64("id") % 1000).alias("d"), F.repeat(F.lit("x"), 40).alias("payload"))
    for parts in (8, 50):
        got = P.dense_index(rows, ["d", "id"], "i", n_parts=parts)
        x = got.agg(F.countDistinct("i"), F.min("i"), F.max("i"), F.countDistinct("id"), F.count("payload")).first()
        assert tuple(x) == (n, 0, n - 1, n, n)
    keyed = rows.withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7))
    got = P.number_within_groups(keyed, ["k"], ["d", "id"], "rn", n_parts=16).groupBy("k").agg(
        F.countDistinct("rn").alias("a"), F.max("rn").alias("b"), F.count("payload").alias("c"))
    assert all(r["a"] == r["c"] == r["b"] + 1 for r in got.collect())
    req = IO.batch_requests(rows.select("id", F.col("payload").alias("prompt")), ["id"], "m", "s")
    assert req.select("custom_id").distinct().count() == n


def test_keep_first_on_maps_and_white_space(spark):
    df = spark.createDataFrame([(1, 2, {"a": "x"}), (1, 1, {"b": "y"}), (2, 5, None)], "k int, o int, m map<string,string>")
    assert {r["k"]: r["m"] for r in P.keep_first(df, ["k"], ["o"]).collect()} == {1: {"b": "y"}, 2: None}
    e = spark.createDataFrame([("Write on 'The Cat\t'.",)], "q string").select(P.entity_from_question(F.col("q")).alias("e")).first()
    assert e["e"] == "The Cat"
