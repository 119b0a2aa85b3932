import math
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from consonance.operators import claims as H
from consonance.operators import paths as P


def _graph(spark, graphs):
    """graphs: {g: (edges, nodes)} -> (edges, nodes) frames."""
    e = [(g, a, b, float(w)) for g, (edges, _) in graphs.items() for a, b, w in edges]
    n = [(g, v) for g, (_, nodes) in graphs.items() for v in nodes]
    return spark.createDataFrame(e, "g string, src string, dst string, w double"), spark.createDataFrame(n, "g string, node string")


def _random_graphs(seed, count=12):
    rnd, out = random.Random(seed), {}
    for i in range(count):
        claims, resps = [f"c{k}" for k in range(rnd.randint(1, 8))], [f"r{k}" for k in range(rnd.randint(1, 4))]
        edges = [(c, r, rnd.choice([1, 1, 2])) for c in claims for r in resps if rnd.random() < 0.4]
        if edges:
            out[f"g{i}"] = (edges, claims + resps)
    return out


def _brute_paths(edges, nodes, weighted=False):
    """Betweenness by listing all shortest paths, closeness by relaxing all edges until nothing changes."""
    w = {}
    for a, b, x in edges:
        if a != b:
            w[a, b] = w[b, a] = min(x if weighted else 1, w.get((a, b), math.inf))
    n, bet, clo = len(nodes), defaultdict(float), {}
    for s in nodes:
        dist = {s: 0}
        while True:
            better = {v: dist[u] + x for (u, v), x in w.items() if u in dist and dist[u] + x < dist.get(v, math.inf)}
            if not better:
                break
            for v, x in better.items():
                dist[v] = min(dist[u] + y for (u, t), y in w.items() if t == v and u in dist)
        def paths(t):
            return [[s]] if t == s else [p + [t] for (u, v), x in w.items() if v == t and u in dist and dist[u] + x == dist[t] for p in paths(u)]
        for t in dist:
            found = paths(t)
            for p in found:
                for v in p[1:-1]:
                    bet[v] += 1 / len(found)
        far = [d for d in dist.values() if d]
        clo[s] = len(far) / sum(far) * len(far) / (n - 1) if far else 0.0
    return {v: bet[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v in nodes}, clo


@pytest.mark.parametrize("form", [P.path_centralities, P.path_centralities_joined])
@pytest.mark.parametrize("weight", [None, "w"])
def test_paths_equal_brute_force(spark, form, weight):
    graphs = {**_random_graphs(1), "hand": ([("c0", "r0", 1), ("c1", "r0", 1), ("c1", "r1", 1)], ["c0", "c1", "c2", "r0", "r1"]),
              "weights": ([("c0", "r0", 1), ("r0", "c1", 1), ("c0", "c1", 2), ("c0", "r1", 5), ("c1", "r1", 3), ("r1", "r1", 1), ("c0", "r0", 4)], ["c0", "c1", "r0", "r1"])}
    edges, nodes = _graph(spark, graphs)
    counts = nodes.groupBy("g").count().withColumnRenamed("count", "n_nodes")
    got = {(r["g"], r["node"]): (r["betweenness"], r["closeness"]) for r in form(edges, counts, ["g"], weight).collect()}
    for g, (es, vs) in graphs.items():
        bet, clo = _brute_paths(es, vs, weight is not None)
        for v in vs:
            assert got.get((g, v), (0.0, 0.0)) == pytest.approx((bet[v], clo[v])), (g, v)
    assert got[("hand", "c1")][0] == pytest.approx(1 / 3) and got[("hand", "c0")][1] == pytest.approx(3 / 6 * 3 / 4)


def test_paths_of_no_edges(spark):
    edges, nodes = _graph(spark, {"a": ([("x", "y", 1)], ["x", "y"])})
    counts = nodes.groupBy("g").count().withColumnRenamed("count", "n_nodes")
    for form in (P.path_centralities, P.path_centralities_joined, P.closeness_sketched, P.betweenness_sampled):
        assert form(edges.limit(0), counts, ["g"]).count() == 0


def _one_large_graph(spark, n=400, m=900, seed=5):
    rnd = random.Random(seed)
    edges = [("one", f"v{i}", f"v{rnd.randrange(i)}", 1.0) for i in range(1, n)] + [("one", f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}", 1.0) for _ in range(m - n)]
    e = spark.createDataFrame(edges, "g string, src string, dst string, w double")
    nodes = spark.createDataFrame([("one", f"v{i}") for i in range(n)], "g string, node string")
    return e, nodes, nodes.groupBy("g").count().withColumnRenamed("count", "n_nodes")


def test_sketched_closeness_is_within_its_error(spark):
    edges, _, counts = _one_large_graph(spark)
    want = {r["node"]: r["closeness"] for r in P.path_centralities(edges, counts, ["g"]).collect()}
    got = {r["node"]: r["closeness"] for r in P.closeness_sketched(edges, counts, ["g"], lg_registers=12).collect()}
    assert got.keys() == want.keys()
    errors = [abs(got[v] / want[v] - 1) for v in want]
    assert max(errors) < 6 * 1.04 / 2**6 and np.mean(errors) < 0.03


def test_sampled_betweenness_is_within_its_error(spark):
    edges, _, counts = _one_large_graph(spark, 250, 500)
    want = {r["node"]: r["betweenness"] for r in P.path_centralities(edges, counts, ["g"]).collect()}
    got = {r["node"]: r["betweenness"] for r in P.betweenness_sampled(edges, counts, ["g"], error=0.2, failure=0.05).collect()}
    assert P.sample_size(0.2, 0.05, 250) < 250
    assert max(abs(got.get(v, 0.0) - want[v]) for v in want) <= 0.2
    assert np.mean([abs(got.get(v, 0.0) - want[v]) for v in want]) < 0.01
    exact = {r["node"]: r["betweenness"] for r in P.betweenness_sampled(edges, counts, ["g"], error=0.01).collect()}  # more sources than nodes
    for v in want:
        assert exact.get(v, 0.0) == pytest.approx(want[v], abs=1e-9)


@pytest.mark.parametrize("weight", [None, "w"])
def test_sampled_betweenness_in_a_task_equals_brute_force(spark, monkeypatch, weight):
    graphs = {**_random_graphs(6), "odd": ([("c0", "r0", 1), ("c0", "r0", 4), ("r0", "c1", 1), ("c0", "c1", 2), ("c1", "c1", 1), ("c0", "r1", 5), ("c1", "r1", 3)], ["c0", "c1", "r0", "r1", "r2"])}
    edges, nodes = _graph(spark, graphs)
    edges = edges.union(spark.createDataFrame([(None, "c0", "r0", 1.0), (None, "c1", "r0", 1.0)], edges.schema))
    counts = nodes.groupBy("g").count().withColumnRenamed("count", "n_nodes")
    frame = edges.filter("g IS NOT NULL").toPandas() if weight else edges.filter("g IS NOT NULL").toPandas().assign(w=1.0)
    whole = P._dependency_sums(["g"], 1000)(frame[frame.src != frame.dst])
    monkeypatch.setattr(P, "CELLS", 20)      # graphs one by one, few sources at a time
    cut = P._dependency_sums(["g"], 1000)(frame[frame.src != frame.dst])
    assert (whole[["g", "node"]] == cut[["g", "node"]]).all(axis=None) and np.allclose(whole["b"], cut["b"], atol=1e-12)
    got = {(r["g"], r["node"]): r["betweenness"] for r in P.betweenness_sampled(edges, counts, ["g"], weight_col=weight).collect()}
    mixed = {(r["g"], r["node"]): r["betweenness"] for r in P.betweenness_sampled(edges, counts, ["g"], weight_col=weight, task_cells=40).collect()}
    assert got.keys() == mixed.keys() and None not in {g for g, _ in got}
    for g, (es, vs) in graphs.items():
        bet, _ = _brute_paths(es, vs, weight is not None)
        for v in vs:
            assert got.get((g, v), 0.0) == pytest.approx(bet[v], abs=1e-9) and mixed.get((g, v), 0.0) == pytest.approx(bet[v], abs=1e-9), (g, v)


def test_sampled_sources_in_a_task_are_those_of_the_joins(spark):
    edges, _, counts = _one_large_graph(spark, 60, 75)
    apart = spark.createDataFrame([("one", f"x{i}", f"x{i + 1}", 1.0) for i in range(0, 12, 2)], edges.schema)
    both = [{r["node"]: r["betweenness"] for r in P.betweenness_sampled(edges.unionByName(apart), counts, ["g"], 0.4, 0.9, task_cells=n).collect()} for n in (10**6, 0)]
    assert P.sample_size(0.4, 0.9, 72) < 30 and both[0].keys() == both[1].keys()
    for v, x in both[0].items():
        assert x == pytest.approx(both[1][v], abs=1e-12)


def test_dependencies_of_small_graphs_write_no_rounds(spark):
    """A long path takes as many jobs as a short one: no round is written."""
    edges, nodes = _graph(spark, {"path": ([(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(39)], [f"n{i:02}" for i in range(40)])})
    counts = nodes.groupBy("g").count().withColumnRenamed("count", "n_nodes")
    got, jobs = _jobs(spark, "between", lambda: {r["node"]: r["betweenness"] for r in P.betweenness_sampled(edges, counts, ["g"]).collect()})
    assert jobs < 20 and all(got[f"n{i:02}"] == pytest.approx(2 * i * (39 - i) / (39 * 38)) for i in range(40))


def test_stacks_are_cut_to_their_bound(spark, monkeypatch):
    r = np.random.default_rng(0)
    w = np.where(r.random((30, 6, 6)) < 0.4, r.integers(1, 4, (30, 6, 6)), np.inf)
    w = np.minimum(w, w.transpose(0, 2, 1))
    w[:, np.arange(6), np.arange(6)] = np.inf
    whole = P.all_pairs(w)
    for i in range(30):
        for a, b in zip(whole, P.all_pairs(w[i: i + 1])):
            assert (a[i] == b[0]).all()


def _power_limit(edges, nodes, weighted):
    """Projection of the uniform vector on the eigenspace of the largest eigenvalue."""
    pos = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for s, t, w in edges:
        a[pos[s], pos[t]] = a[pos[t], pos[s]] = w if weighted else 1
    lam, vec = np.linalg.eigh(a)
    top = vec[:, lam > lam[-1] - 1e-9]
    x = top @ (top.T @ np.ones(len(nodes)))
    return dict(zip(nodes, x / np.linalg.norm(x)))


@pytest.mark.parametrize("weight", [None, "w"])
def test_eigenvector_is_the_limit_of_power_iteration(spark, weight):
    stars = [("c0", "r0", 1), ("c1", "r0", 1), ("c2", "r1", 1), ("c3", "r1", 1)]
    graphs = {**_random_graphs(2), "twins": (stars, ["c0", "c1", "c2", "c3", "r0", "r1"])}
    edges, _ = _graph(spark, graphs)
    for form in (H.eigenvector, H.eigenvector_exact):
        got = {(r["g"], r["node"]): r["eigenvector"] for r in form(edges, ["g"], weight).collect()}
        for g, (es, vs) in graphs.items():
            for v, x in _power_limit(es, vs, weight is not None).items():
                assert got.get((g, v), 0.0) == pytest.approx(x, abs=1e-5), (g, v)
        assert got[("twins", "r0")] == pytest.approx(got[("twins", "r1")])


def test_eigenvector_of_one_large_graph(spark):
    """Tens of thousands of edges, a hub whose edges are salted: the vector is that of power iteration on the edges."""
    r = np.random.default_rng(8)
    n, m = 4000, 30_000
    a, b = r.integers(0, n, m), r.integers(0, n, m)
    hub = np.arange(1, 600)
    pairs = np.unique(np.sort(np.stack([np.concatenate([a, np.zeros(len(hub), int)]), np.concatenate([b, hub])], 1)[:, :], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    edges = spark.createDataFrame(pd.DataFrame({"g": "one", "src": pairs[:, 0], "dst": pairs[:, 1]}))
    got = {x["node"]: x["eigenvector"] for x in H.eigenvector(edges, ["g"], hub_edges=200).collect()}
    x = np.ones(n)
    for _ in range(3000):
        y = x + np.bincount(pairs[:, 0], x[pairs[:, 1]], n) + np.bincount(pairs[:, 1], x[pairs[:, 0]], n)
        y /= np.linalg.norm(y)
        if np.abs(y - x).max() < 1e-13:
            break
        x = y
    assert max(abs(got.get(i, 0.0) - x[i]) for i in range(n)) < 1e-5


def test_eigenvectors_in_a_task_equal_those_by_joins(spark):
    graphs = _random_graphs(12, 6)
    large = [(f"c{i}", f"r{i // 2}", 1) for i in range(12)] + [(f"c{i}", f"r{(i * 5 + 3) % 6}", 2) for i in range(12)]
    edges, _ = _graph(spark, {**graphs, "large": (large, sorted({v for a, b, _ in large for v in (a, b)}))})
    odd = spark.createDataFrame([(None, "c0", "r0", 1.0), ("loop", "c0", "c0", 2.0), ("loop", "c0", "r0", 1.0), ("twice", "c0", "r0", 1.0), ("twice", "c0", "r0", 1.0)], edges.schema)
    both = [{(r["g"], r["node"]): r["eigenvector"] for r in H.eigenvector(edges.unionByName(odd), ["g"], "w", task_edges=n).collect()} for n in (100_000, 8)]
    assert both[0].keys() == both[1].keys() and None not in {g for g, _ in both[0]}
    for k, x in both[0].items():
        assert x == pytest.approx(both[1][k], abs=2e-5), k


def _jobs(spark, group, run):
    """The result of ``run`` and how many jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_restarts_of_small_graphs_are_no_jobs(spark):
    """A path of 60 nodes has nearly equal eigenvalues: it takes many restarts, and as many jobs as a graph of two nodes."""
    path = [(f"n{i}", f"n{i + 1}", 1) for i in range(59)]
    edges, _ = _graph(spark, {"path": (path, []), "pair": ([("a", "b", 1)], [])})
    got, jobs = _jobs(spark, "eigen", lambda: {(r["g"], r["node"]): r["eigenvector"] for r in H.eigenvector(edges, ["g"]).collect()})
    for v, x in _power_limit(path, [f"n{i}" for i in range(60)], False).items():
        assert got["path", v] == pytest.approx(x, abs=1e-3)
    assert got["pair", "a"] == pytest.approx(0.5**0.5) and jobs < 15
    with pytest.raises(RuntimeError):
        H.eigenvector(edges, ["g"], max_restarts=1)


def _brute_pagerank(edges, nodes, weighted, d=0.85, rounds=400):
    pos, n = {v: i for i, v in enumerate(nodes)}, len(nodes)
    a = np.zeros((n, n))
    for s, t, w in edges:
        a[pos[s], pos[t]] += w if weighted else 1
        a[pos[t], pos[s]] += w if weighted else 1
    out = a.sum(1)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        x = d * (a / np.where(out > 0, out, 1)[:, None]).T @ x + d * x[out == 0].sum() / n + (1 - d) / n
    return dict(zip(nodes, x))


@pytest.mark.parametrize("weight", [None, "w"])
def test_pagerank_to_a_tolerance(spark, weight):
    graphs = _random_graphs(3)
    edges, nodes = _graph(spark, graphs)
    got = {(r["g"], r["node"]): r["rank"] for r in H.pagerank(edges, nodes, ["g"], tol=1e-9, weight_col=weight).collect()}
    for g, (es, vs) in graphs.items():
        for v, x in _brute_pagerank(es, vs, weight is not None).items():
            assert got[(g, v)] == pytest.approx(x, abs=1e-7)
    with pytest.raises(RuntimeError):
        H.pagerank(edges, nodes, ["g"], tol=1e-12, max_iter=10)


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("rounds", [0, 1, 7, 23])
def test_pagerank_rounds_from_the_uniform_vector(spark, weight, rounds):
    graphs = _random_graphs(4, 5)
    edges, nodes = _graph(spark, graphs)
    got = {(r["g"], r["node"]): r["rank"] for r in H.pagerank(edges, nodes, ["g"], weight_col=weight, iterations=rounds).collect()}
    assert len(got) == nodes.count()
    for g, (es, vs) in graphs.items():
        for v, x in _brute_pagerank(es, vs, weight is not None, rounds=rounds).items():
            assert got[(g, v)] == pytest.approx(x, abs=1e-12)


@pytest.mark.parametrize("weight", [None, "w"])
def test_ranks_in_a_task_equal_those_by_joins(spark, weight):
    graphs = {**_random_graphs(9, 6), "alone": ([("c0", "r0", 1)], ["c0", "r0", "c1", "c2"]), "large": ([(f"c{i}", f"r{i % 3}", 1) for i in range(12)], [f"c{i}" for i in range(12)] + ["r0", "r1", "r2"])}
    edges, nodes = _graph(spark, graphs)
    nodes = nodes.union(spark.createDataFrame([(None, "c0"), ("void", "c0")], nodes.schema))
    both = [{(r["g"], r["node"]): r["rank"] for r in H.pagerank(edges, nodes, ["g"], weight_col=weight, task_edges=n).collect()} for n in (100_000, 25)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == nodes.count() - 1 and both[0]["void", "c0"] == 1
    for k, x in both[0].items():
        assert x == pytest.approx(both[1][k], abs=1e-14), k
    twice = {(r["g"], r["node"]): r["rank"] for r in H.pagerank(edges, nodes.union(nodes), ["g"], weight_col=weight).collect()}
    assert twice == pytest.approx(both[0])


def test_rounds_of_small_graphs_are_no_jobs(spark):
    edges, nodes = _graph(spark, _random_graphs(3))
    got, jobs = _jobs(spark, "ranks", lambda: H.pagerank(edges, nodes, ["g"], tol=1e-12).collect())
    assert len(got) == nodes.count() and jobs < 12


def test_pagerank_of_one_group_of_all_rows(spark):
    """A hub of most edges: its edges are dealt to salts, no exchange of a round is keyed by the group alone, and each
    partition gets its part of the hub's edges."""
    import re

    from consonance.operators import graphs as GR

    edges, nodes, _ = _one_large_graph(spark, 300, 600)
    star = spark.range(300).selectExpr("'one' AS g", "'v0' AS src", "concat('v', id) AS dst", "1.0D AS w").filter("dst <> 'v0'")
    edges = edges.unionByName(star)
    got = {r["node"]: r["rank"] for r in H.pagerank(edges, nodes, ["g"], tol=1e-10, hub_edges=20).collect()}
    want = _brute_pagerank([(r.src, r.dst, 1) for r in edges.collect()], [r.node for r in nodes.collect()], False)
    for v, x in want.items():
        assert got[v] == pytest.approx(x, abs=1e-8)
    share = GR._shares(edges, nodes, ["g"], None, hub_edges=20)
    held = [r["count"] for r in share.filter("src = 'v0'").groupBy("salt").count().collect()]
    assert len(held) >= 15 and max(held) < 60
    start = nodes.join(share.filter("own = 1").selectExpr("g", "src AS node", "salts"), ["g", "node"]).selectExpr("*", "1.0D AS y")
    plan = GR._step(share, start, ["g"], "y", ["y"])._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and all(k.count("#") >= 2 for k in keys), keys


def test_index_join_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta eps zz"), (2, "alpha beta gamma"), (3, "Zalpha beta gamma delta epsY"),
                                  (4, "nothing here at all"), (5, "b"), (6, ""), (7, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha beta gamma delta eps"), (11, "beta gamma"), (12, "at all"), (13, "b"), (14, "ha beta gam"), (15, ""), (16, None),
                                   (17, "a beta gamma d"), (18, "!!"), (19, "here at")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in H.containment_edges(items, docs, "item_id", "text", "doc_id", "text").collect()}
    assert got == {(i, d) for i, it in items.collect() for d, dt in docs.collect() if it and dt and it in dt}


def test_index_join_with_groups_equals_brute_force(spark):
    rnd = random.Random(8)
    words = ["a", "an", "bee", "sea", "deer", "eel", "fox"]
    texts = [(g, i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for g in ("x", "y") for i in range(8)]
    claims = [(g, i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for g in ("x", "y") for i in range(40)]
    r, c = spark.createDataFrame(texts, "g string, rid int, t string"), spark.createDataFrame(claims, "g string, cid int, t string")
    got = {tuple(x) for x in H.containment_edges(c, r, "cid", "t", "rid", "t", ["g"]).select("g", "cid", "rid").collect()}
    assert got == {(g, i, j) for g, i, ct in claims for h, j, rt in texts if g == h and ct in rt}


def test_edges_of_small_groups_by_pairs_equal_those_by_grams(spark, monkeypatch):
    texts = [("x", 1, "red car, fast car"), ("x", 1, "red car, fast car"), ("x", 2, "a red car"), ("x", None, "red car"), ("x", 3, None),
             ("y", 1, "red car"), (None, 1, "red car")]
    claims = [("x", 10, "red car"), ("x", 11, "ast"), ("x", 12, ""), ("x", 13, None), ("y", 10, "fast"), (None, 10, "red car"), ("z", 1, "red")]
    r, c = spark.createDataFrame(texts, "g string, rid int, t string"), spark.createDataFrame(claims, "g string, cid int, t string")
    got = {}
    for pairs in (H.PAIRS, 8, 0):   # all groups by pairs, the larger one by n-grams, all by n-grams
        monkeypatch.setattr(H, "PAIRS", pairs)
        got[pairs] = sorted(tuple(x) for x in H.containment_edges(c, r, "cid", "t", "rid", "t", ["g"]).select("g", "cid", "rid").collect())
    assert got[8] == got[0] == got[H.PAIRS] and ("x", 10, 2) in got[0] and len(got[0]) == 9


@pytest.mark.parametrize("pairs", [100_000, 0])
def test_grouped_texts_are_not_broadcast(spark, monkeypatch, pairs):
    monkeypatch.setattr(H, "PAIRS", pairs)
    r = spark.createDataFrame([("x", 1, "red car, fast car")], "g string, rid int, t string")
    c = spark.createDataFrame([("x", 10, "red car")], "g string, cid int, t string")
    plan = H.containment_edges(c, r, "cid", "t", "rid", "t", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"Broadcast\w+Join.*(_g|_rk)", plan), plan


def test_claim_union_first_occurrence(spark):
    occ = spark.createDataFrame([("g", 2, 7, "B"), ("g", 1, 8, " b "), ("g", 1, 9, "C"), ("g", 3, 9, "C")],
                                "g string, doc_id int, claim_id long, text string")
    u = sorted((r["claim_idx"], r["claim_id"]) for r in H.claim_union(occ, ["g"], ["doc_id"], "text").collect())
    assert u == [(0, 8), (1, 9)]


def test_from_atoms_to_metrics_with_composite_keys(spark):
    atoms = [("a", 1, 0, 0, "red car"), ("a", 1, 0, 1, "fast"), ("a", 1, 1, 0, "Red  car"), ("a", 1, 1, 1, "never said"), ("a", 2, 0, 0, "red car")]
    resp = [("a", 1, 0, "a red car is fast"), ("a", 1, 1, "the red car"), ("a", 2, 0, "red car"), ("b", 1, 0, "red car")]
    at = spark.createDataFrame(atoms, "k string, q int, response_idx int, atom_idx int, text string")
    re_ = spark.createDataFrame(resp, "k string, q int, response_idx int, response string")
    got = {(r["k"], r["q"], r["node_id"]): r for r in H.graph_uncertainty(at, re_, ["k", "q"]).collect()}
    assert set(got) == {("a", 1, 0), ("a", 1, 1), ("a", 1, 2), ("a", 2, 0)}
    assert [got[("a", 1, i)]["degree"] for i in range(3)] == [2.0, 1.0, 0.0]
    assert got[("a", 1, 2)]["pagerank"] > 0 and got[("a", 1, 2)]["closeness"] == 0 and got[("a", 1, 0)]["betweenness"] > 0


def test_weighted_degrees_and_empty_side(spark):
    e = spark.createDataFrame([("g", 1, 5, 0.5), ("g", 1, 6, 2.0)], "g string, claim_id int, response_id int, w double")
    c, r = spark.createDataFrame([("g", 1), ("g", 2)], "g string, claim_id int"), spark.createDataFrame([("g", 5), ("g", 6)], "g string, response_id int")
    got = {(x["side"], x["node_id"]): x["degree"] for x in H.degrees(e, c, r, ["g"], "w").collect()}
    assert got == {("claim", 1): 2.5, ("claim", 2): 0.0, ("response", 5): 0.5, ("response", 6): 2.0}
    with pytest.raises(ValueError):
        H.claim_metrics(H.degrees(e, c, r, ["g"]).withColumn("node", H.F.lit("n")), c, ["g"], side="other")


def test_prefix_filtered_cover_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(g, j, " ".join(rnd.sample(vocab, rnd.randint(0, 6)))) for g in range(5) for j in range(12)]
    df = spark.createDataFrame(rows, "g int, claim_idx int, text string")
    for tau in (0.5, 0.8, 1.0):
        got = {(r["g"], r["claim_idx"]) for r in H.drop_covered_claims(df, ["g"], "claim_idx", "text", tau).collect()}
        want = set()
        for g, j, text in rows:
            tj = set(text.split())
            covered = bool(tj) and any(i < j and gi == g and len(tj & set(ti.split())) >= math.ceil(tau * len(tj))
                                       for gi, i, ti in rows)
            if not covered:
                want.add((g, j))
        assert got == want, tau
