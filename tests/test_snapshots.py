import tempfile

import pytest
from consonance.sources.snapshots import Conflict, SnapshotTable
from pyspark.sql import functions as F

ROWS = "k long, v string, ts long"


def _table(spark, buckets=8):
    return SnapshotTable(spark, tempfile.mkdtemp(prefix="consonance-snap-") + "/t", ["k"], buckets)


def _df(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_replace_is_atomic(spark):
    t = _table(spark)
    assert t.read() is None
    t.replace(_df(spark, [(i, "a", 0) for i in range(100)]))
    before = t.read()

    def broken(batches):
        for pdf in batches:
            if (pdf["k"] == 7).any():
                raise ValueError("a task fails while it writes")
            yield pdf

    bad = _df(spark, [(i, "b", 1) for i in range(100)]).repartition(8).mapInPandas(broken, ROWS)
    with pytest.raises(Exception, match="a task fails"):
        t.replace(bad)
    assert t.read().filter("v = 'a'").count() == 100 == t.read().count()   # the old version is whole
    t.replace(_df(spark, [(i, "c", 2) for i in range(50)]))
    assert t.read().filter("v = 'c'").count() == 50 == t.read().count()
    assert before.count() == 100   # a reader of the old version keeps it
    t.vacuum(keep=1)
    assert t.read().count() == 50 and len(t._names("data")) == 1


def test_an_incomplete_manifest_is_not_there(spark):
    t = _table(spark)
    t.replace(_df(spark, [(1, "a", 0)]))
    fs, path = t._hadoop("manifests/000000000002.json")
    out = fs.create(path, False)
    out.write(b'{"version": 2, "folders": {}')
    out.close()
    assert t.manifest()["version"] == 1 and t.read().count() == 1
    t.replace(_df(spark, [(1, "b", 0), (2, "b", 0)]))
    assert t.manifest()["version"] == 3 and t.read().count() == 2


def test_two_writers_of_one_version(spark):
    t = _table(spark)
    t.replace(_df(spark, [(1, "a", 0)]))
    old = t.manifest()
    t.append(_df(spark, [(2, "b", 0)]))
    with pytest.raises(Conflict):
        t._commit(old, folders={})
    assert t.read().count() == 2


def test_upsert_touches_its_buckets_only(spark):
    t = _table(spark, buckets=32)
    old = [(i, "a", i % 3) for i in range(500)] + [(None, "n", 0)]
    t.replace(_df(spark, old))
    before = t.manifest()["folders"]
    new = [(3, "b", 5), (4, "b", -1), (1000, "b", 0), (None, "m", 1)]
    touched = t.upsert(_df(spark, new), "ts")
    after = t.manifest()["folders"]
    assert 1 <= len(touched) <= 4 and all(after[b] == before[b] for b in before if b not in touched)
    got = {r.k: (r.v, r.ts) for r in t.read().collect()}
    want = {k: (v, ts) for k, v, ts in old} | {3: ("b", 5), 1000: ("b", 0), None: ("m", 1)}
    assert got == want and t.read().count() == len(want)
    # what was read for it: the files of the touched buckets
    plan = t._read(t.manifest(), touched)
    assert {f.split("/b=")[1].split("/")[0] for f in plan.inputFiles()} == set(touched)
    assert t.upsert(_df(spark, []), "ts") == []


def test_extend_numbers_on(spark):
    t = SnapshotTable(spark, tempfile.mkdtemp(prefix="consonance-snap-") + "/t", ["q"], 16)
    rows = lambda b, n: spark.range(n).selectExpr("id % 20 AS q", "CAST(id DIV 20 AS INT) AS response_idx", f"{b} AS batch", "id AS payload")
    t.replace(rows(0, 100))
    touched = t.extend(rows(1, 100).filter("q < 3"), ["q"])
    assert len(touched) <= 3
    got = t.read().groupBy("q").agg(F.count("*").alias("n"), F.max("response_idx").alias("m"), F.countDistinct("response_idx").alias("d")).collect()
    assert {(r.q, r.n, r.m, r.d) for r in got} == {(q, 10, 9, 10) if q < 3 else (q, 5, 4, 5) for q in range(20)}


def test_appends_are_counted_once(spark):
    t = _table(spark)
    assert t.append(_df(spark, [(1, "a", 0)]), ("s", 0)) and not t.append(_df(spark, [(1, "a", 0)]), ("s", 0))
    assert t.append(_df(spark, [(1, "a", 0)]), ("s", 1)) and t.append(_df(spark, [(2, "a", 0)]), ("other", 0))
    assert t.read().count() == 3 and t.marks() == {"s": 1, "other": 0}
    t.compact(lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"), F.sum("ts").alias("ts")), max_folders=1)
    assert t.read().count() == 2
