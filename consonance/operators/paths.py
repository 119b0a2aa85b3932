"""Shortest-path centralities (H5 betweenness, H8 closeness) of edge tables ``(group…, src, dst[, weight])``.

Three forms, chosen by the caller:

* ``path_centralities``: exact, weighted or not, for many graphs that are each small (one per question): graphs of
  equal size are worked on together with numpy, a task takes thousands of them.
* ``path_centralities_joined``: exact, for graphs that a task should not hold: a relaxation join per round for
  all graphs and sources at once. Its tables have a row per connected pair of nodes.
* ``closeness_sketched`` and ``betweenness_sampled``: estimates with stated errors for graphs of any size:
  HyperLogLog counters passed along edges, and exact dependencies of a hashed sample of sources. Rows per
  round are in proportion to the edges (and to the sample). Dependencies in graphs of few edges times sources are found in
  tasks, by the rounds of the joins on arrays.

Weights are lengths, greater than 0; of several edges between two nodes the shortest counts; loops are no
paths. Both measures follow the usual normalisation for undirected graphs: betweenness by
(n - 1)(n - 2) over ordered pairs, closeness with the component's share (r / Σd · r / (n - 1)). Isolated nodes have 0 in both.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .graphs import SPREAD, both_ways, with_group_row
from .grouped import graph_stacks, large_groups, map_sorted_groups, numbered_graphs

CELLS = 2_000_000     # of a stack of n × n matrices, of edges × sources
TASK_CELLS = 50_000_000    # edges (both ways) × sources of a graph whose dependencies are found in one task
CLOSE = 1e-9          # lengths that differ by less, relatively, are equal


# ---------------------------------------------------------------- many small graphs

def all_pairs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, numbers of shortest paths, dependencies) for a stack (graph, n, n) of edge lengths (inf: none).

    ``dependencies[g, s, v]`` is the share of v in the shortest paths from s, summed over their ends. Nodes are settled from all
    sources at once: step k takes, for each source, its k-th nearest node.
    """
    g, n, _ = w.shape
    dist = w.copy()
    dist[:, np.arange(n), np.arange(n)] = 0
    for k in range(n):
        np.minimum(dist, dist[:, :, k, None] + dist[:, None, k, :], out=dist)
    order = np.argsort(dist, axis=2, kind="stable")
    gi, si = np.indices((g, n))
    sigma = np.zeros_like(dist)
    sigma[:, np.arange(n), np.arange(n)] = 1
    by_target = np.ascontiguousarray(w.transpose(0, 2, 1))

    def before(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th nearest node v of each source, and which nodes come just before v on shortest paths."""
        v = order[:, :, k]
        end = dist[gi, si, v]
        gap = np.abs(dist + by_target[gi, v] - end[:, :, None])
        return v, (gap <= CLOSE * np.maximum(end, 1e-300)[:, :, None]) & np.isfinite(end)[:, :, None] & (end > 0)[:, :, None]

    with np.errstate(invalid="ignore"):
        for k in range(1, n):
            v, pred = before(k)
            sigma[gi, si, v] += (pred * sigma).sum(2)
        delta = np.zeros_like(dist)
        for k in range(n - 1, 0, -1):
            v, pred = before(k)
            count = sigma[gi, si, v]
            share = np.where(count > 0, (1 + delta[gi, si, v]) / np.where(count > 0, count, 1), 0)
            delta += pred * sigma * share[:, :, None]
    return dist, sigma, delta


def _scores(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(betweenness before normalisation, reached nodes, sum of distances) per graph and node."""
    dist, _, delta = all_pairs(w)
    n = w.shape[1]
    delta[:, np.arange(n), np.arange(n)] = 0
    far = np.isfinite(dist) & (dist > 0)
    return delta.sum(1), far.sum(2), np.where(far, dist, 0).sum(2)


def _kernel(g: list[str]):
    def batch_fn(edges: pd.DataFrame) -> pd.DataFrame:
        outs = []
        for stack, rows in graph_stacks(edges, g, np.inf, np.minimum, CELLS):
            between, reached, total = _scores(stack)
            rows["b"], rows["r"], rows["total"] = between.ravel(), reached.ravel(), total.ravel()
            outs.append(rows)
        return pd.concat(outs, ignore_index=True)

    return batch_fn


def _normalised(found: DataFrame, node_counts: DataFrame, g: list[str], spread: int = SPREAD) -> DataFrame:
    """``found``: (group…, node, b, r, total), joined to the number of nodes of its group."""
    n = F.col("n_nodes")
    return with_group_row(found, node_counts.select(*g, "n_nodes"), g, spread).select(
        *g, "node", F.when(n > 2, F.coalesce("b", F.lit(0.0)) / ((n - 1) * (n - 2))).otherwise(0.0).alias("betweenness"),
        F.when((n > 1) & (F.col("total") > 0), (F.col("r") / F.col("total")) * (F.col("r") / (n - 1))).otherwise(0.0).alias("closeness"))


def path_centralities(edges: DataFrame, node_counts: DataFrame, group_cols: list[str], weight_col: str | None = None) -> DataFrame:
    """H5 + H8: ``(group…, node, betweenness, closeness)`` of connected nodes of graphs that are small each
    (n² numbers of a graph are in a task), normalised by ``node_counts(group…, n_nodes)``."""
    g = group_cols
    w = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    e = edges.select(*g, "src", "dst", w.alias("w"))
    schema = T.StructType([e.schema[c] for c in g] + [T.StructField("node", e.schema["src"].dataType)]
                          + [T.StructField(c, t) for c, t in (("b", T.DoubleType()), ("r", T.LongType()), ("total", T.DoubleType()))])
    return _normalised(map_sorted_groups(e, g, _kernel(g), schema), node_counts, g)


# ---------------------------------------------------------------- by joins

def _adjacent(edges: DataFrame, g: list[str], weight_col: str | None) -> DataFrame:
    """(group…, u, v, w) in both directions, the shortest of parallel edges, no loops."""
    e = both_ways(edges, g, weight_col).filter("src <> dst")
    return cut_lineage(e.groupBy(*g, F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("w").alias("w")))


def _distances(adj: DataFrame, starts: DataFrame, g: list[str]) -> DataFrame:
    """(group…, s, v, d) from each start node ``s`` to every node it reaches: each round relaxes the edges of the
    nodes whose distance fell in the round before."""
    known = cut_lineage(starts.select(*g, "s", F.col("s").alias("v"), F.lit(0.0).alias("d")))
    fresh = known
    while True:
        step = fresh.join(adj.withColumnRenamed("v", "to").withColumnRenamed("u", "v"), [*g, "v"]).groupBy(*g, "s", F.col("to").alias("v")).agg(
            F.min(F.col("d") + F.col("w")).alias("x"))
        both = cut_lineage(known.join(step, [*g, "s", "v"], "full"))
        better = F.col("d").isNull() | (F.col("x") < F.col("d") * (1 - CLOSE))
        fresh = both.filter(F.col("x").isNotNull() & better).select(*g, "s", "v", F.col("x").alias("d"))
        known = both.select(*g, "s", "v", F.when(F.col("x").isNotNull() & better, F.col("x")).otherwise(F.col("d")).alias("d"))
        if fresh.isEmpty():
            return known


def _series(start: DataFrame, links: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Σ_h M^h x for the links a → b of an acyclic graph: (keys…, node, x) added up over rounds."""
    term, total = start, start
    while True:
        term = cut_lineage(term.withColumnRenamed("node", a).join(links, [*keys, a]).groupBy(*keys, F.col(b).alias("node")).agg(F.sum("x").alias("x")))
        if term.isEmpty():
            return cut_lineage(total.groupBy(*keys, "node").agg(F.sum("x").alias("x")))
        total = total.unionByName(term)


def dependencies(adj: DataFrame, starts: DataFrame, group_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distances (group…, s, v, d), dependencies (group…, s, v, delta) for v ≠ s) from each start node.

    Shortest paths from s are the paths of an acyclic graph of links u → v with d(u) + w = d(v). Their
    numbers, and the dependencies divided by them, are power series along those links and against them.
    """
    g = group_cols
    keys = [*g, "s"]
    dist = cut_lineage(_distances(adj, starts, g))
    near, far = dist.select(*keys, F.col("v").alias("u"), F.col("d").alias("du")), dist.select(*keys, "v", F.col("d").alias("dv"))
    links = near.join(adj, [*g, "u"]).join(far, [*keys, "v"]).filter(
        F.abs(F.col("du") + F.col("w") - F.col("dv")) <= CLOSE * F.col("dv")).select(*keys, "u", "v")
    links = cut_lineage(links)
    sigma = _series(dist.filter("s = v").select(*keys, F.col("v").alias("node"), F.lit(1.0).alias("x")), links, keys, "u", "v")
    # delta(u) / sigma(u) = Σ over v behind u of 1 / sigma(v) + delta(v) / sigma(v)
    inverse = cut_lineage(sigma.select(*keys, "node", (1 / F.col("x")).alias("x")))
    behind = _series(inverse, links, keys, "v", "u").withColumnRenamed("x", "y")
    delta = behind.join(sigma, [*keys, "node"]).filter("node <> s").select(*keys, F.col("node").alias("v"), (F.col("x") * F.col("y") - 1).alias("delta"))
    return dist, delta


def path_centralities_joined(edges: DataFrame, node_counts: DataFrame, group_cols: list[str], weight_col: str | None = None) -> DataFrame:
    """H5 + H8 as ``path_centralities``, by joins: a row per connected pair of nodes, no graph in one task."""
    g = group_cols
    adj = _adjacent(edges, g, weight_col)
    dist, delta = dependencies(adj, adj.select(*g, F.col("u").alias("s")).distinct(), g)
    near = dist.filter("d > 0").groupBy(*g, F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("total"))
    deps = delta.groupBy(*g, F.col("v").alias("node")).agg(F.sum("delta").alias("b"))
    return _normalised(near.join(deps, [*g, "node"], "left"), node_counts, g)


# ---------------------------------------------------------------- estimates for graphs of any size

def closeness_sketched(edges: DataFrame, node_counts: DataFrame, group_cols: list[str], lg_registers: int = 10, max_rounds: int = 1000) -> DataFrame:
    """H8, estimated: ``(group…, node, closeness)`` of connected nodes, paths counted in edges.

    Every node holds a HyperLogLog sketch of the nodes within t edges; a round merges its neighbours'
    sketches into it. The number of nodes at distance t is the growth of the estimate in round t. Relative standard error of
    an estimate of reached nodes: about 1.04 / √(2^lg_registers), 3 % for 10; rows per round are
    nodes and edges, each with 2^lg_registers bytes at most. Rounds end when no sketch of any graph changes.
    """
    g = group_cols
    both = cut_lineage(both_ways(edges, g, None).filter("src <> dst").select(*g, "src", "dst").distinct())
    nodes = both.select(*g, F.col("src").alias("node")).distinct()
    sketch = F.hll_sketch_agg(F.xxhash64("node"), lg_registers)
    state = cut_lineage(nodes.groupBy(*g, "node").agg(sketch.alias("sk")).withColumns({"size": F.lit(1.0), "total": F.lit(0.0)}))
    for t in range(1, max_rounds + 1):
        sent = both.join(state.select(*g, F.col("node").alias("src"), "sk"), [*g, "src"]).select(*g, F.col("dst").alias("node"), "sk")
        merged = sent.unionByName(state.select(*g, "node", "sk")).groupBy(*g, "node").agg(F.hll_union_agg("sk").alias("sk2"))
        grown = F.greatest(F.hll_sketch_estimate("sk2").cast("double"), F.col("size"))
        state = cut_lineage(state.join(merged, [*g, "node"]).select(
            *g, "node", F.col("sk2").alias("sk"), grown.alias("size"), (F.col("total") + t * (grown - F.col("size"))).alias("total"), (grown > F.col("size")).alias("changed")))
        if state.filter("changed").isEmpty():
            break
    found = state.select(*g, "node", F.lit(0.0).alias("b"), (F.col("size") - 1).alias("r"), "total")
    return _normalised(found, node_counts, g).select(*g, "node", "closeness")


def sample_size(error: float, failure: float, n: int) -> int:
    """Sources after which every node's betweenness is within ``error`` with probability 1 - ``failure``: by Hoeffding's
    bound for each node, whose normalised dependency on a source lies in [0, 1], and the union of ``n`` nodes."""
    return math.ceil(math.log(2 * max(n, 1) / failure) / (2 * error**2))


def betweenness_sampled(edges: DataFrame, node_counts: DataFrame, group_cols: list[str], error: float = 0.05, failure: float = 0.01,
                        weight_col: str | None = None, seed: int = 0, task_cells: int = TASK_CELLS) -> DataFrame:
    """H5, estimated: ``(group…, node, betweenness)`` of the nodes that lie on a path from a sampled source.

    Per graph, ``sample_size`` of its connected nodes (all, if fewer; then the result is exact) with the least seeded hashes are
    sources, and dependencies on them are exact. The mean over sources, times the connected nodes over all nodes, estimates
    the betweenness within ``error`` of a node's value for all nodes of a graph with probability 1 - ``failure``.
    Graphs of at most ``task_cells`` edges times sources are each in one task, the others go by joins.
    """
    from .prep import group_subset

    g = group_cols
    e = both_ways(edges, g, weight_col).filter("src <> dst").dropna()
    sizes = cut_lineage(e.groupBy(*g, "src").agg(F.count(F.lit(1)).alias("_n")).groupBy(*g).agg(
        F.count(F.lit(1)).alias("connected"), F.sum("_n").alias("links")))
    k = sample_size(error, failure, sizes.agg(F.max("connected")).first()[0] or 1)
    large = large_groups(sizes, g, F.least("connected", F.lit(k)) * F.col("links") <= task_cells)
    small = edges.select(*g, "src", "dst", (F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")).alias("w")).filter("src <> dst").dropna()
    sampled = cut_lineage(sizes.filter(F.col("connected") > k).select(*g))
    starts = None if sampled.isEmpty() else cut_lineage(group_subset(
        e.join(sampled, g, "left_semi").select(*g, F.col("src").alias("s")).distinct(), g, "s", k, seed))
    by_joins = None
    if large is not None:
        held, some = small.join(large, g, "left_semi"), sizes.join(large, g, "left_semi").select(*g, "connected")
        small, adj = small.join(large, g, "left_anti"), _adjacent(held, g, "w")
        every = adj.select(*g, F.col("u").alias("s")).distinct()
        if starts is not None:
            every = every.join(sampled, g, "left_anti").unionByName(starts.join(large, g, "left_semi"))
            starts = starts.join(large, g, "left_anti")
        by_joins = _sampled_by_joins(adj, every, g, some, k)
    if starts is not None:      # as loops, which are no paths
        small = small.unionByName(starts.select(*g, F.col("s").alias("src"), F.col("s").alias("dst"), F.lit(0.0).alias("w")))
    schema = T.StructType([small.schema[c] for c in g] + [T.StructField("node", small.schema["src"].dataType), T.StructField("b", T.DoubleType())])
    none = [F.lit(0).cast("long").alias("r"), F.lit(0.0).alias("total")]
    found = map_sorted_groups(small, g, _dependency_sums(g, k), schema).select(*g, "node", "b", *none)
    out = _normalised(found, node_counts, g, spread=1)
    if by_joins is not None:
        out = out.unionByName(_normalised(by_joins.select(*g, "node", "b", *none), node_counts, g))
    return out.select(*g, "node", "betweenness")


def _sampled_by_joins(adj: DataFrame, starts: DataFrame, g: list[str], held: DataFrame, k: int) -> DataFrame:
    """(group…, node, b): sums of the dependencies on ``starts``, ``k`` per graph at most, scaled to all ``held`` connected nodes."""
    _, delta = dependencies(adj, starts, g)
    sums = delta.groupBy(*g, F.col("v").alias("node")).agg(F.sum("delta").alias("b"))
    scale: Column = F.greatest(F.col("connected") / F.lit(k), F.lit(1.0))
    return with_group_row(sums, held, g).select(*g, "node", (F.col("b") * scale).alias("b"))


def _dependency_sums(g: list[str], k: int):
    """Dependencies of every node on the sources of its graph, summed and scaled, for the graphs of a frame of edges. Loops name the
    sources of their graph, ``k``; in a graph without loops every node is one. There are no dependencies between components, so
    those of all graphs are worked on together."""

    def batch_fn(edges: pd.DataFrame) -> pd.DataFrame:
        src, dst, w, first, nodes = numbered_graphs(edges, g)
        sizes = np.diff(np.append(first, len(nodes)))
        source = np.zeros(len(nodes), bool)
        source[src[src == dst]] = True
        source |= np.repeat(~np.logical_or.reduceat(source, first), sizes)
        nodes["scale"] = np.repeat(np.maximum(sizes / k, 1), sizes)
        src, dst, w = src[src != dst], dst[src != dst], w[src != dst]
        place, nodes = _by_component(src, dst, nodes.assign(source=source))
        src, dst, source = place[src], place[dst], nodes["source"].to_numpy()
        order = np.lexsort((w, src, dst))       # the shortest of parallel edges
        src, dst, w = src[order], dst[order], w[order]
        kept = np.append(True, (np.diff(src) != 0) | (np.diff(dst) != 0))
        src, dst, w = src[kept], dst[kept], w[kept]
        ends = np.append(np.flatnonzero(np.append(True, np.diff(nodes["part"].to_numpy()) != 0)), len(nodes))
        links = np.searchsorted(dst, ends)      # edges by their component
        held = np.add.reduceat(source.astype(np.int64), ends[:-1])
        rank = np.cumsum(source) - 1            # the column in which a node is the source: its place among those of its component
        rank = np.where(source, rank - np.repeat(np.cumsum(held) - held, np.diff(ends)), -1)
        b, place = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
        for parts, columns in _parts(held, np.diff(links)):
            own = np.concatenate([np.arange(links[i], links[i + 1]) for i in parts])
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in parts])
            place[at] = np.arange(len(at))
            s, t, most = place[src[own]], place[dst[own]], int(held[parts].max())
            for j in range(0, most, columns):
                b[at] += _summed(s, t, w[own], rank[at] - j, min(columns, most - j))
        on_paths = np.repeat(held, np.diff(ends)) - source > 0
        return nodes.assign(b=b * nodes["scale"])[on_paths][[*g, "node", "b"]]

    return batch_fn


def _by_component(src: np.ndarray, dst: np.ndarray, nodes: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """(where each node goes, ``nodes`` in that order with the component as ``part``): the nodes of a component together.
    The edges are in both directions."""
    part = np.arange(len(nodes))
    order = np.argsort(dst, kind="stable")
    src, runs = src[order], np.searchsorted(dst[order], part)
    while True:
        least = np.minimum(part, np.minimum.reduceat(part[src], runs))
        least = least[least]
        if (least == part).all():
            break
        part = least
    order = np.argsort(part, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    return place, nodes.iloc[order].reset_index(drop=True).assign(part=part[order])


def _parts(n: np.ndarray, links: np.ndarray):
    """(components, sources at a time): those of like numbers of sources ``n`` together, about ``CELLS`` edges × sources at a time."""
    order = np.argsort(n, kind="stable")
    at = np.searchsorted(n[order], 1)       # those without a source are left out
    while at < len(order):
        end, total = at + 1, links[order[at]]
        while end < len(order) and (total + links[order[end]]) * n[order[end]] <= CELLS:
            total += links[order[end]]
            end += 1
        yield order[at:end], max(1, int(min(n[order[end - 1]], CELLS // total)))
        at = end


def _summed(s: np.ndarray, t: np.ndarray, w: np.ndarray, start: np.ndarray, sources: int) -> np.ndarray:
    """Dependencies of each node, summed over the sources of ``sources`` columns: in column c those with ``start`` c, one in a component.

    The edges s → t are in both directions and in the order of t, which every node is. The rounds are those of ``dependencies``.
    """
    runs = np.searchsorted(t, np.arange(len(start)))
    source = start[:, None] == np.arange(sources)
    d = np.where(source, 0.0, np.inf)
    while True:
        x = np.minimum.reduceat(d[s] + w[:, None], runs, axis=0)
        better = x < d * (1 - CLOSE)
        if not better.any():
            break
        d = np.where(better, x, d)
    with np.errstate(invalid="ignore"):
        into = np.abs(d[s] + w[:, None] - d[t]) <= CLOSE * d[t]      # s comes just before t
        back = np.abs(d[t] + w[:, None] - d[s]) <= CLOSE * d[s]

    def series(x: np.ndarray, along: np.ndarray) -> np.ndarray:
        term, total = x, x.copy()
        while term.any():
            term = np.add.reduceat(np.where(along, term[s], 0.0), runs, axis=0)
            total += term
        return total

    sigma = series(source.astype(float), into)
    reached = sigma > 0
    behind = series(np.where(reached, 1 / np.where(reached, sigma, 1), 0), back)
    return np.where(reached & ~source, sigma * behind - 1, 0).sum(1)
