"""One-permutation near-dedup, lexical search and hard negatives: against brute force, edges included."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from consonance.llm import hard_negatives, lexical, oph_dedup
from pyspark.sql import functions as F

from conftest_llm import CLASHING, EDGE_ROWS, prose, words_of

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- near-dedup

def spaced(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_dedup(rows):
    sets = []
    for _, text in rows:
        w = spaced(text)
        sets.append({tuple(w[i: i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[i] if r == root[j] else r for r in root]
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root[i]] = min(d, ids.get(root[i], d))
    least = [ids.get(root[i]) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return Counter((d, len(sets[i]), least[i], d == least[i]) for i, (d, _) in enumerate(rows))


def got_dedup(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in oph_dedup.dedup(df, **options).collect())


def near_copies(n, changes, seed):
    """Texts of 120 words, each with its own changed words: most pairs lie near the threshold."""
    r, base = random.Random(seed), prose(seed, 120).split()
    out = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice(changes)):
            w[at] = f"w{seed}x{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_dedup_is_brute_force(spark, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # pairs that differ in 5 + 5 words are below 0.8, in 5 + 2 words above: members are linked over others than their centre
    planted = near_copies(40, [2, 5, 8], 1) + near_copies(30, [6, 7], 2) + near_copies(3, [1], 3)
    rows += [(10_000 + i, t) for i, t in enumerate(planted)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_dedup(df, block=block) == brute_dedup(rows)


def test_chain_of_texts_is_one_component(spark):
    # each text shares 0.8 or more with the next one only: links form a path
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i: 8 * i + 101])) for i in range(30)]
    got = got_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_dedup(rows) and {k[2] for k in got} == {0}


def test_small_sets_and_their_bins():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 3000):
        h = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        s = oph_dedup.signature(h, 384)
        assert len(s) == 384 and set(s.tolist()) <= set(h.tolist()) and h[0] in s
        # a set with one more element keeps the values of most bins
        more = oph_dedup.signature(np.unique(np.append(h, r.integers(0, 1 << 64, 1, dtype=np.uint64))), 384)
        assert (s == more).mean() > 1 - 3 / (n + 1)
    a, b = np.arange(10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64)
    assert oph_dedup.alike(a, b, 80) and not oph_dedup.alike(a, b, 81) and not oph_dedup.alike(a, b[1:], 80)


def test_words_across_pieces(monkeypatch):
    text = ("Ab\x00c d\teé " * 40 + "x" * 300 + "\x0b\x1f y").encode()
    want = oph_dedup.shingles(text, 2)
    monkeypatch.setattr(oph_dedup, "BLOCK", 64)
    assert (oph_dedup.shingles(text, 2) == want).all()
    w = spaced(text.decode())
    assert len(want) == len({tuple(w[i: i + 2]) for i in range(len(w) - 1)})


def test_dedup_edges(edge_docs, no_docs):
    assert got_dedup(edge_docs) == brute_dedup([r[:2] for r in EDGE_ROWS])
    assert oph_dedup.dedup(no_docs).count() == 0


# ---------------------------------------------------------------- lexical search

def brute_rank(docs, items, k):
    tokens = [words_of(t) for _, t in docs]
    count = [Counter(w) for w in tokens]
    n_docs, n_words = sum(1 for w in tokens if w), sum(len(w) for w in tokens)
    df = Counter(t for c in count for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), w, c in zip(docs, tokens, count):
            s = 0
            for t in set(words_of(text)):
                if c[t]:
                    m = 100 - 50 + (50 * len(w) * n_docs) // n_words
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("slice_terms", [65_536, 300])
def test_lexical_search_is_brute_force(spark, edge_docs, benchmark, slice_terms):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(benchmark)
    got = lexical.rank(docs.repartition(3).withColumn("score", F.lit(1)), items.withColumn("rank", F.lit("x")), k=7, slice_terms=slice_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_rank([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 7)


def test_lexical_search_empty_tables(edge_docs, no_docs, benchmark):
    assert lexical.rank(no_docs, benchmark).count() == 0
    assert lexical.rank(edge_docs, benchmark.limit(0)).count() == 0
    assert lexical.rank(edge_docs, benchmark.filter("item_id = 6")).count() == 0


def test_query_dag_adds_up_each_item_and_shares_work():
    r = random.Random(4)
    common = [r.sample(range(60), 12) for _ in range(4)]
    items = [np.unique(r.choice(common) + r.choice(common) + r.sample(range(60, 200), 6)) for _ in range(50)]
    known = np.unique(np.concatenate(items))
    items = [np.searchsorted(known, x) for x in items]
    dag = lexical.query_dag(items, len(known))
    value = np.array([[r.randrange(10**9) for _ in range(3)] for _ in known])
    term, doc = (x.ravel() for x in np.indices(value.shape))
    got = dag.scores(term, doc, value.ravel(), 3)
    assert (got == np.stack([value[x].sum(0) for x in items])).all()
    plain = sum(len(x) - 1 for x in items)
    shared = dag.n_nodes - dag.n_groups + len(dag.parts) - dag.n_items + len(known) - dag.n_groups
    assert shared < plain / 2
    held = defaultdict(set)
    for i, a in enumerate(dag.begin):
        for p in dag.parts[a: dag.begin[i + 1] if i + 1 < dag.n_items else None].tolist():
            held[p].add(i)
    pairs = Counter(frozenset((a, b)) for a in held for b in held if a < b for _ in held[a] & held[b])
    assert max(pairs.values(), default=0) < 2   # nothing shared is left


# ---------------------------------------------------------------- hard negatives

def brute_mine(rows, positives=5, negatives=10):
    good = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    d = max(sorted({len(g[2]) for g in good}), key=lambda n: sum(len(g[2]) == n for g in good), default=0)
    good = [g for g in good if len(g[2]) == d]
    out = []
    for a, (aid, alabel, ax) in enumerate(good):
        if aid % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(ax, x)), i, label) for b, (i, label, x) in enumerate(good) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == alabel)[:positives]:
            fits = sorted(s for s in scored if s[2] != alabel and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(aid, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(fits[:negatives])]
    return Counter(out)


VEC = "vec_id long, embedding array<float>, label int"


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, label, **options).collect())


@pytest.mark.parametrize("slice_anchors", [4096, 2])
def test_negatives_are_brute_force(spark, slice_anchors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ITEMS", 64)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(r[0] + 1, r[1], r[2]) for r in rows[:40]] + rows[100:102]   # equal vectors, repeated rows (an anchor too)
    df = spark.createDataFrame(rows, VEC).repartition(3)
    assert mined(df, slice_anchors=slice_anchors) == brute_mine(rows)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5, -0.25], 1), (1, [0.5, 0.4, 0.1], 1), (2, [0.3, 0.3, 0.1], 2), (3, [0.3, 0.3, 0.1], 3), (3, [0.3, 0.3, 0.1], 3), (4, None, 1), (5, [None, 1.0, 1.0], 1),
            (6, [nan, 1.0, 1.0], 2), (8, [inf, 1.0, 1.0], 2), (9, [1.0], 2), (10, [], 2), (11, [0.4, 0.4, 0.4], None), (None, [0.4, 0.4, 0.4], 2), (100, [-0.5, 0.0, 0.0], 1),
            (200, [0.0, 0.0, 0.0], 4), (300, [0.5, 0.5, -0.25], 1), (300, [0.5, 0.5, -0.25], 1)]
    df = spark.createDataFrame(rows, VEC)
    own = [c for c in CLASHING if c not in ("id", "x", "label")]
    clashing = df.withColumns({**{c: F.lit("own") for c in own}, "id": F.lit("own"), "x": F.lit("own"), "row_id": F.lit("own"), "anchor": F.lit("own")})
    assert mined(clashing) == brute_mine(rows)
    assert not mined(df.limit(0)) and not mined(df.filter("vec_id = 200"))
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [3e9], 1)], VEC))


def test_bounds_hold_and_rule_out():
    r = np.random.default_rng(6)
    centres = r.normal(0, 60, (5, 1)) + r.normal(0, 8, (5, 64))
    x, y = (np.floor(centres[r.integers(0, 5, n)] + r.normal(0, 4, (n, 64))) for n in (30, 400))
    a, b = hard_negatives.Side(x), hard_negatives.Side(y)
    exact = x @ y.T
    left = []
    for (ma, da), (mb, db) in zip(a.levels, b.levels):
        assert (ma @ mb.T + da @ db.T >= exact - 1e-6).all() and (ma @ mb.T - da @ db.T <= exact + 1e-6).all()
        left.append((ma @ mb.T + da @ db.T >= np.quantile(exact, 0.95, axis=1)[:, None]).mean())
    assert left[0] < 0.5 and left == sorted(left, reverse=True)
    low, high = np.quantile(exact, 0.9, axis=1), np.quantile(exact, 0.97, axis=1)
    i, j, s = hard_negatives.pairs_in_range(a, b, np.ones(exact.shape, bool), low, high)
    wi, wj = np.nonzero((exact >= low[:, None]) & (exact <= high[:, None]))
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == set(zip(wi.tolist(), wj.tolist(), exact[wi, wj].astype(int).tolist()))
