"""Graph operators on edge tables ``(group…, src, dst[, weight])``: principal eigenvector (H6) and PageRank (H7).

A table holds one graph per group. Graphs may have any size and any number. Those of at most ``TASK_EDGES`` rows go
through their rounds in a task, many at once as one graph without links between them. For larger ones rounds are joins and
aggregations keyed by (group, node), so one group that holds all rows is spread like many, and
nodes of very many edges are salted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .grouped import graph_stacks, large_groups, map_sorted_groups, numbered_graphs

PAGERANK_D = 0.85
MAX_ITER = 1000
TOL = 1e-6
STEPS_PER_JOB = 10
TASK_EDGES = 100_000  # edges (and nodes) of a graph that goes through its rounds in one task
HUB_EDGES = 100_000   # edges of one node that a task may hold
SPREAD = 32           # parts of a group when one row per group is joined back to its nodes


def both_ways(edges: DataFrame, g: list[str], weight_col: str | None) -> DataFrame:
    w = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    e = edges.select(*g, "src", "dst", w.alias("w"))
    return e.unionByName(e.select(*g, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def with_group_row(nodes: DataFrame, per_group: DataFrame, g: list[str], spread: int = SPREAD) -> DataFrame:
    """``nodes`` (with a ``node`` column) with the columns of its group's row of ``per_group``. The rows are copied
    to ``spread`` parts of a group, so that a group's nodes meet them in as many partitions."""
    names = {c: f"_of_{c}" for c in g}
    parts = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_p")).withColumnsRenamed(names)
    dealt = nodes.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(spread)).cast("int"))
    same = F.col("_part") == F.col("_p")
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return dealt.join(parts, same).drop("_part", "_p", *names.values())


def _shares(edges: DataFrame, nodes: DataFrame, g: list[str], weight_col: str | None, hub_edges: int, shared: bool = True) -> DataFrame:
    """(group…, src, salt, dst, w, own, salts): what share of its value a node hands to each neighbour, or
    (not ``shared``) the weight it hands it on with.

    Edges of a node with more than ``hub_edges`` of them are dealt to salts. A loop of weight 0 and
    ``own`` 1 carries each node's value and its number of salts along, so a round reads the values once.
    """
    both = both_ways(edges, g, weight_col)
    out = both.groupBy(*g, "src").agg(F.sum("w").alias("total"), F.ceil(F.count(F.lit(1)) / F.lit(hub_edges)).cast("int").alias("salts"))
    dealt = both.join(out, [*g, "src"]).select(
        *g, "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst", (F.col("w") / F.col("total") if shared else F.col("w")).alias("w"), F.lit(0.0).alias("own"), F.lit(0).alias("salts"))
    loops = nodes.select(*g, F.col("node").alias("src")).join(out, [*g, "src"], "left").select(
        *g, "src", F.lit(0).alias("salt"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.lit(1.0).alias("own"), F.coalesce("salts", F.lit(1)).alias("salts"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(dealt.unionByName(loops)).repartition(parts, *g, "src", "salt")


def _step(share: DataFrame, state: DataFrame, g: list[str], value: str, kept: list[str]) -> DataFrame:
    """(group…, node, salts, c, kept…): the sum ``c`` of what a node's neighbours hand on of ``value``."""
    r = state.select(*g, F.col("node").alias("src"), value, *[c for c in kept if c != value], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    given = share.join(r, [*g, "src", "salt"])
    return given.groupBy(*g, F.col("dst").alias("node")).agg(
        F.sum(F.col("own") * F.col("salts")).cast("int").alias("salts"), F.sum(F.col("w") * F.col(value)).alias("c"),
        *[F.sum(F.col("own") * F.col(c)).alias(c) for c in kept])


def pagerank(edges: DataFrame, nodes: DataFrame, group_cols: list[str], d: float = PAGERANK_D, tol: float = TOL,
             max_iter: int = MAX_ITER, weight_col: str | None = None, iterations: int | None = None, hub_edges: int = HUB_EDGES,
             task_edges: int = TASK_EDGES) -> DataFrame:
    """H7: ``(group…, node, rank)``, for graphs of any size.

    ``edges``: ``group…, src, dst[, weight]`` (undirected); ``nodes``: ``group…, node`` (every node, once). Uniform
    teleport and uniform redistribution of dangling mass. Stops when no group's ranks change by
    ``n · tol`` in sum, and raises if that takes more than ``max_iter`` rounds; ``iterations`` asks for the ranks
    after that many rounds from the uniform vector instead.

    With A handing each node's value to its neighbours (dangling nodes hand on nothing), ranks are in
    proportion to y = 1 + d A y: what teleport and dangling mass add is the same for every node, so no round
    needs a group's sum, and one division at the end makes ranks of y. Graphs of at most ``task_edges`` nodes and edges go
    through all rounds in a task, the others by joins; all groups get as many rounds as the slowest needs.
    """
    g = group_cols
    if iterations is not None:
        share = _shares(edges, nodes, g, weight_col, hub_edges)
        return _ranks_after(share, _started(share, nodes, g), g, d, iterations)
    w = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    own = nodes.select(*g, "node").dropna()
    # a loop of weight 0 stands for a node: isolated ones come along
    rows = edges.select(*g, "src", "dst", w.alias("w")).dropna().unionByName(
        own.select(*g, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")))
    large = large_groups(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g, F.col("_n") <= task_edges)
    small = rows if large is None else rows.join(large, g, "left_anti")
    needed = map_sorted_groups(small, g, _rounds_needed(g, d, tol, max_iter), T.StructType([T.StructField("rounds", T.LongType())]))
    done, state = needed.agg(F.max("rounds")).first()[0] or 0, None
    if large is not None and done <= max_iter:
        held = cut_lineage(own.join(large, g, "left_semi").distinct())
        share = _shares(edges.join(large, g, "left_semi"), held, g, weight_col, hub_edges)
        state, done = _ranked_by_joins(share, _started(share, held, g), g, d, tol, done, max_iter)
    if done > max_iter:
        raise RuntimeError(f"pagerank: not within {tol} per node after {max_iter} rounds")
    schema = T.StructType([rows.schema[c] for c in g] + [T.StructField("node", rows.schema["src"].dataType), T.StructField("rank", T.DoubleType())])
    found = map_sorted_groups(small, g, _ranks_in_task(g, d, done), schema)
    return found if state is None else found.unionByName(state)


def _started(share: DataFrame, nodes: DataFrame, g: list[str]) -> DataFrame:
    return nodes.select(*g, "node").join(share.filter("own = 1").select(*g, F.col("src").alias("node"), "salts"), [*g, "node"])


def _ranked_by_joins(share: DataFrame, start: DataFrame, g: list[str], d: float, tol: float, least: int, max_iter: int) -> tuple[DataFrame, int]:
    """(ranks, rounds) of the graphs of ``share`` after ``least`` rounds or as many more as they need; rounds beyond ``max_iter``: not reached."""
    state, done = cut_lineage(start.withColumn("y", F.lit(1.0))), 0
    while done < max_iter:
        for _ in range(min(STEPS_PER_JOB, max_iter - done)):
            state = _step(share, state, g, "y", ["y"]).select(*g, "node", "salts", (1 + d * F.col("c")).alias("y"), F.col("y").alias("before"))
            done += 1
        state = cut_lineage(state)
        moved = state.groupBy(*g).agg(F.sum(F.abs(F.col("y") - F.col("before"))).alias("e"), F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))
        if done >= least and moved.filter(F.col("e") >= F.col("total") * F.col("n") * tol).isEmpty():
            break
    else:
        done = max_iter + 1
    total = state.groupBy(*g).agg(F.sum("y").alias("total"))
    return with_group_row(state, total, g).select(*g, "node", (F.col("y") / F.col("total")).alias("rank")), done


class _Spread:
    """The graphs of a frame of rows (group…, src, dst, w) with y = 1 + d A y of all of them."""

    def __init__(self, rows: pd.DataFrame, g: list[str], d: float):
        self.src, self.dst, w, self.first, self.nodes = numbered_graphs(rows, g)
        total = np.bincount(self.src, w, len(self.nodes))
        self.w, self.y = d * w / np.where(total > 0, total, 1)[self.src], np.ones(len(self.nodes))

    def step(self) -> np.ndarray:
        """The values before a round."""
        before, self.y = self.y, 1 + np.bincount(self.dst, self.w * self.y[self.src], len(self.y))
        return before

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first)


def _rounds_needed(g: list[str], d: float, tol: float, max_iter: int):
    def batch_fn(rows: pd.DataFrame) -> pd.DataFrame:
        at, done = _Spread(rows, g, d), 0
        n = at.sums(np.ones(len(at.y)))
        while done < max_iter:
            for _ in range(min(STEPS_PER_JOB, max_iter - done)):
                before = at.step()
                done += 1
            if (at.sums(np.abs(at.y - before)) < at.sums(at.y) * n * tol).all():
                break
        else:
            done = max_iter + 1
        return pd.DataFrame({"rounds": [done]})

    return batch_fn


def _ranks_in_task(g: list[str], d: float, rounds: int):
    def batch_fn(rows: pd.DataFrame) -> pd.DataFrame:
        at = _Spread(rows, g, d)
        for _ in range(rounds):
            at.step()
        at.nodes["rank"] = at.y / np.repeat(at.sums(at.y), np.diff(np.append(at.first, len(at.y))))
        return at.nodes

    return batch_fn


def _ranks_after(share: DataFrame, start: DataFrame, g: list[str], d: float, k: int) -> DataFrame:
    """The k-th iterate from the uniform vector.

    With v_j = A^(j+1) 1, s_j its sum over the group and b_i = 1 - d S_i the mass that round i spreads evenly
    (times n; S_i the sum of what edges carried), the k-th ranks are (b_k + Σ_{j<k} d^(j+1) b_(k-1-j) v_j) / n, where b_0 = 1 and
    S_i = Σ_{j<i} d^j b_(i-1-j) s_j / n. So the vectors need no sums of groups while they are made; the b of a
    group are folded from its k sums afterwards. ``STEPS_PER_JOB`` vectors are columns of one table.
    """
    n = start.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    if k == 0:
        return with_group_row(start, n, g).select(*g, "node", (1 / F.col("n")).alias("rank"))
    state, blocks = start.withColumn("v", F.lit(1.0)), []
    for at in range(0, k, STEPS_PER_JOB):
        names = [f"v{j}" for j in range(at, min(at + STEPS_PER_JOB, k))]
        r, value = state, "v"
        for i, name in enumerate(names):
            r, value = _step(share, r, g, value, names[:i]).withColumnRenamed("c", name), name
        blocks.append(cut_lineage(r.select(*g, "node", "salts", *names)))
        state = blocks[-1].select(*g, "node", "salts", F.col(names[-1]).alias("v"))
    sums = n
    for b in blocks:
        sums = sums.join(b.groupBy(*g).agg(*[F.sum(c).alias(c) for c in b.columns if c.startswith("v")]), g)
    spread = F.array(*[F.col(f"v{j}") * d**j for j in range(k)])

    def fold(acc: Column, _: Column) -> Column:
        carried = F.aggregate(F.zip_with(F.reverse(acc), F.slice("spread", 1, F.size(acc)), lambda b, s: b * s), F.lit(0.0), lambda a, x: a + x)
        return F.concat(acc, F.array(1 - d * carried / F.col("n")))

    b = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(F.lit(1.0)), fold)
    per_group = cut_lineage(sums.select(*g, "n", spread.alias("spread")).select(*g, "n", b.alias("b")))
    parts = []
    for at, block in zip(range(0, k, STEPS_PER_JOB), blocks):
        names = [c for c in block.columns if c.startswith("v")]
        terms = [F.col(c) * d ** (at + i + 1) * F.element_at("b", k - at - i) for i, c in enumerate(names)]
        base = F.element_at("b", k + 1) if at == 0 else F.lit(0.0)
        parts.append(with_group_row(block, per_group, g).select(*g, "node", ((base + sum(terms)) / F.col("n")).alias("rank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*g, "node").agg(F.sum("rank").alias("rank"))


# ---------------------------------------------------------------- H6

STACK_CELLS = 2_000_000
KRYLOV = 10      # products with the adjacency matrix per restart
RESTARTS = 200


def _ritz_stack(gram: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per graph, from the products <p_i, p_j> of the basis p_0 … p_m (graph, m + 1, m + 1): coefficients of the top Ritz vector of
    p_0 … p_(m-1), its Ritz value, and the greater of two distances: from p_0, and a tenth of that of A x from its multiple of x.

    With A p_0 = s p_1 and A p_j = s (p_(j+1) + p_(j-1)) / 2 the products with A follow from those of the basis.
    """
    m = gram.shape[1] - 1
    base = gram[:, :m, :m]
    ahead, behind = gram[:, :m, 1:], np.concatenate([gram[:, :m, 1:2], gram[:, :m, : m - 1]], axis=2)
    h = scale[:, None, None] * (ahead + behind) / 2
    lam, u = np.linalg.eigh(base)
    keep = lam > 1e-12 * lam[:, -1:]
    q = np.where(keep, 1 / np.sqrt(np.where(keep, lam, 1)), 0)[:, None, :] * u
    projected = q.transpose(0, 2, 1) @ (h + h.transpose(0, 2, 1)) @ q / 2
    # what is not kept comes below all else
    low = -1 - 2 * np.abs(projected).sum((1, 2))
    projected[:, np.arange(m), np.arange(m)] += np.where(keep, 0, low[:, None])
    theta, y = np.linalg.eigh(projected)
    theta, c = theta[:, -1], np.einsum("gij,gj->gi", q, y[:, :, -1])
    # A x in the basis; what it has besides theta x is the residual
    half = scale[:, None] * c / 2
    ax = np.zeros((len(c), m + 1))
    ax[:, 1:] += half
    ax[:, :m - 1] += half[:, 1:]
    ax[:, 1] += half[:, 0]
    size = np.maximum(theta, 1e-300)
    residual = np.sqrt(np.maximum(0.0, np.einsum("gi,gij,gj->g", ax, gram, ax) / size**2 - 1))
    along = np.einsum("gi,gi->g", c, base[:, :, 0])
    c = np.where(along >= 0, 1, -1)[:, None] * c
    apart = np.sqrt(np.maximum(0.0, 1 - along**2 / base[:, 0, 0]))
    return c, np.maximum(theta, 0.0), np.maximum(apart, residual / 10)


def _ritz(sums: pd.DataFrame, g: list[str], m: int) -> pd.DataFrame:
    """``_ritz_stack`` of the sums x{i}_{j} (i ≤ j) of a frame with a row per group."""
    gram = np.zeros((len(sums), m + 1, m + 1))
    for i in range(m + 1):
        for j in range(i, m + 1):
            gram[:, i, j] = gram[:, j, i] = sums[f"x{i}_{j}"]
    c, theta, apart = _ritz_stack(gram, sums["scale"].to_numpy(np.float64))
    return sums[g].assign(c=list(c), theta=theta, apart=apart)


def _restarts_in_task(g: list[str], tol: float, max_restarts: int):
    """The restarts of ``eigenvector`` for the graphs of a frame of edges, each until its own vector stays; ``late``: it did not."""

    def batch_fn(edges: pd.DataFrame) -> pd.DataFrame:
        src, dst, w, first, nodes = numbered_graphs(edges, g)
        sizes = np.diff(np.append(first, len(nodes)))
        found, late = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
        at = np.arange(len(nodes))        # which nodes the rows of p are
        p = np.repeat(1 / np.sqrt(sizes), sizes)
        scale = np.maximum(np.maximum.reduceat(np.bincount(src, w, len(nodes)), first), 1e-300)
        for done in range(max_restarts):
            basis = np.empty((KRYLOV + 1, len(at)))
            basis[0], each = p, np.repeat(scale, sizes)
            for j in range(KRYLOV):
                product = np.bincount(dst, w * basis[j][src], len(at)) / each
                basis[j + 1] = product if j == 0 else 2 * product - basis[j - 1]
            gram = np.empty((len(sizes), KRYLOV + 1, KRYLOV + 1))
            for i in range(KRYLOV + 1):
                gram[:, i, i:] = np.add.reduceat(basis[i] * basis[i:], first, axis=1).T
                gram[:, i:, i] = gram[:, i, i:]
            c, theta, apart = _ritz_stack(gram, scale)
            p = sum(np.repeat(c[:, j], sizes) * basis[j] for j in range(KRYLOV))
            scale = np.maximum(theta, 1e-300)
            going = (apart >= tol) & (done + 1 < max_restarts)
            stay = np.repeat(going, sizes)
            found[at[~stay]], late[at[~stay]] = p[~stay], np.repeat(apart >= tol, sizes)[~stay]
            if not going.any():
                break
            place = np.cumsum(stay) - 1
            kept = stay[src]
            src, dst, w, p, at = place[src[kept]], place[dst[kept]], w[kept], p[stay], at[stay]
            sizes, scale = sizes[going], scale[going]
            first = np.cumsum(sizes) - sizes
        return nodes.assign(eigenvector=np.maximum(found, 0.0), late=late)

    return batch_fn


def eigenvector(edges: DataFrame, group_cols: list[str], weight_col: str | None = None, tol: float = TOL,
                hub_edges: int = HUB_EDGES, max_restarts: int = RESTARTS, task_edges: int = TASK_EDGES) -> DataFrame:
    """H6: ``(group…, node, eigenvector)`` of connected nodes: the projection of the uniform vector on the eigenspace of
    each graph's largest eigenvalue, of unit norm (the limit of shifted power iteration).

    A restart multiplies the vectors of all graphs ``KRYLOV`` times with their adjacency matrices, a round of |E| rows
    each, as the columns of a Chebyshev basis; the Rayleigh-Ritz step on that basis needs only the products of its
    columns per group (one row). The vectors stay in the span that A makes of the uniform vector, so components that
    share the largest eigenvalue keep their shares. Ends when no graph's vector turns by ``tol`` in a restart, and none is
    further than ten times ``tol`` from its own product (raises after ``max_restarts``): nearly equal largest eigenvalues take more
    restarts. Graphs of any size: those of at most ``task_edges`` edges go through their restarts in a task, the others
    by joins. ``eigenvector_exact`` is the form by an eigen-solver.
    """
    g = group_cols
    w = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    rows = edges.select(*g, "src", "dst", w.alias("w")).dropna()
    large = large_groups(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g, F.col("_n") <= task_edges)
    schema = T.StructType([rows.schema[c] for c in g] + [T.StructField("node", rows.schema["src"].dataType),
                          T.StructField("eigenvector", T.DoubleType()), T.StructField("late", T.BooleanType())])
    small = rows if large is None else rows.join(large, g, "left_anti")
    found = cut_lineage(map_sorted_groups(small, g, _restarts_in_task(g, tol, max_restarts), schema))
    if not found.filter("late").isEmpty():
        raise RuntimeError(f"eigenvector: not within {tol} after {max_restarts} restarts")
    found = found.drop("late")
    return found if large is None else found.unionByName(_eigenvector_by_joins(rows.join(large, g, "left_semi"), g, tol, hub_edges, max_restarts))


def _eigenvector_by_joins(edges: DataFrame, g: list[str], tol: float, hub_edges: int, max_restarts: int) -> DataFrame:
    ends = edges.select(*g, F.col("src").alias("node")).union(edges.select(*g, F.col("dst").alias("node"))).distinct()
    nodes = cut_lineage(ends)
    share = _shares(edges, nodes, g, "w", hub_edges, shared=False)
    # a first scale for each graph: no eigenvalue is above the largest sum of a node's weights
    bound = share.filter("own = 0").groupBy(*g, "src").agg(F.sum("w").alias("w")).groupBy(*g).agg(F.max("w").alias("scale"))
    sizes = nodes.groupBy(*g).agg((1 / F.sqrt(F.count(F.lit(1)))).alias("p0"))
    start = nodes.join(share.filter("own = 1").select(*g, F.col("src").alias("node"), "salts"), [*g, "node"])
    state = cut_lineage(with_group_row(start, bound.join(sizes, g), g).select(*g, "node", "salts", "scale", "p0"))
    schema = T.StructType([edges.schema[c] for c in g] + [
        T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("theta", T.DoubleType()), T.StructField("apart", T.DoubleType())])
    names = [f"p{j}" for j in range(KRYLOV + 1)]
    for _ in range(max_restarts):
        r = state
        for j in range(KRYLOV):
            have = ["scale", *names[: j + 1]]
            product = F.col("c") / F.col("scale")
            following = product if j == 0 else 2 * product - F.col(names[j - 1])
            r = _step(share, r, g, names[j], have).select(*g, "node", "salts", *have, following.alias(names[j + 1]))
        basis = cut_lineage(r)
        sums = basis.groupBy(*g).agg(F.max("scale").alias("scale"), *[
            F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"x{i}_{j}") for i in range(KRYLOV + 1) for j in range(i, KRYLOV + 1)])
        found = cut_lineage(sums.mapInPandas(lambda batches: (_ritz(b, g, KRYLOV) for b in batches), schema))
        value = sum(F.col(f"p{j}") * F.element_at("c", j + 1) for j in range(KRYLOV))
        moved = with_group_row(basis.drop("scale"), found, g)
        state = cut_lineage(moved.select(*g, "node", "salts", F.greatest("theta", F.lit(1e-300)).alias("scale"), value.alias("p0")))
        if found.filter(F.col("apart") >= tol).isEmpty():
            # the limit has no negative entries: what is below 0 is rounding
            return state.select(*g, "node", F.greatest("p0", F.lit(0.0)).alias("eigenvector"))
    raise RuntimeError(f"eigenvector: not within {tol} after {max_restarts} restarts")


def eigenvector_exact(edges: DataFrame, group_cols: list[str], weight_col: str | None = None) -> DataFrame:
    """H6 by an eigen-solver: the vectors of ``eigenvector`` for many graphs that are each small (one per question): stacks of
    graphs of equal size, n² numbers of a graph in a task. Eigenvalues that differ by less than 1e-9 of the largest are one."""
    g = group_cols
    w = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    e = edges.select(*g, "src", "dst", w.alias("w"))

    def batch_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        outs = []
        for stack, rows in graph_stacks(pdf, g, 0.0, np.add, STACK_CELLS):
            lam, vec = np.linalg.eigh(stack)
            top = vec * (lam > lam[:, -1:] * (1 - 1e-9) - 1e-12)[:, None, :]
            x = np.einsum("gik,gjk->gi", top, top)   # the projection of the vector of ones
            rows["eigenvector"] = (x / np.linalg.norm(x, axis=1, keepdims=True)).ravel()
            outs.append(rows)
        return pd.concat(outs, ignore_index=True)

    schema = T.StructType([e.schema[c] for c in g] + [T.StructField("node", e.schema["src"].dataType), T.StructField("eigenvector", T.DoubleType())])
    return map_sorted_groups(e, g, batch_fn, schema)
