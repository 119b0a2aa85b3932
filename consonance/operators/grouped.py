"""Many small groups per Python call.

``applyInPandas`` pays an Arrow/pandas round trip per group; with thousands of
small groups that dominates. ``map_sorted_groups`` hash-partitions by the group
key, sorts within partitions and runs ``batch_fn`` on frames holding complete
groups only: the trailing group of each Arrow batch is carried into the next
batch, so a group is never split. Every row of a group still lands in one task,
so this is for groups bounded by construction (e.g. K sampled responses).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_group, cut_lineage


def map_sorted_groups(df: DataFrame, group_cols: list[str], batch_fn, schema: T.StructType) -> DataFrame:
    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf.iloc[-1]
            tail = np.ones(len(pdf), dtype=bool)
            for c in group_cols:
                col = pdf[c]
                tail &= ((col == last[c]) | (col.isna() & pd.isna(last[c]))).to_numpy()
            carry = pdf[tail].reset_index(drop=True)
            done = pdf[~tail].reset_index(drop=True)
            if len(done):
                yield batch_fn(done)
        if carry is not None and len(carry):
            yield batch_fn(carry)

    # by a hash of the group: where rows come from joins or unions by the group, Spark leaves a repartition by the group itself out,
    # and may then read their parts in other tasks
    ordered = by_group(df, [F.xxhash64(*group_cols)]).sortWithinPartitions(*group_cols)
    return ordered.mapInPandas(run, schema=schema)


def large_groups(sizes: DataFrame, group_cols: list[str], small: Column) -> DataFrame | None:
    """The groups of ``sizes`` (a row per group) that are not ``small`` and so no task should hold; None if there are none."""
    large = cut_lineage(sizes.filter(~small).select(*group_cols))
    return None if large.isEmpty() else large


def per_group(fn, group_cols: list[str], names: list[str]):
    """Adapt a one-group kernel ``fn(pdf) -> pdf`` to ``map_sorted_groups``."""

    def batch_fn(done: pd.DataFrame) -> pd.DataFrame:
        outs = [fn(sub) for _, sub in done.groupby(group_cols, sort=False, dropna=False)]
        outs = [o for o in outs if len(o)]
        return pd.concat(outs, ignore_index=True)[names] if outs else pd.DataFrame({n: [] for n in names})

    return batch_fn


def graph_stacks(edges: pd.DataFrame, group_cols: list[str], empty: float, combine, cells: int):
    """The graphs of a frame of edges (group…, src, dst, w; groups complete) as stacks of symmetric n × n matrices, graphs of
    equal size together, at most ``cells`` numbers in a stack: (matrices, group columns and ``node`` as a frame of graphs × n rows).

    ``combine`` is a numpy function of parallel edges, ``empty`` the value where there are none; loops are left out.
    """
    keys = edges.groupby(group_cols, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(keys, kind="stable")
    edges, keys = edges.iloc[order], keys[order]
    first = np.searchsorted(keys, np.arange(keys[-1] + 2))
    src, dst, w = edges["src"].to_numpy(), edges["dst"].to_numpy(), edges["w"].to_numpy(np.float64)
    graphs = []
    for i in range(keys[-1] + 1):
        part = slice(first[i], first[i + 1])
        names, at = np.unique(np.concatenate([src[part], dst[part]]), return_inverse=True)
        half = len(at) // 2
        graphs.append((len(names), i, names, at[:half], at[half:], w[part]))
    graphs.sort(key=lambda x: x[0])
    at = 0
    while at < len(graphs):
        n, end = graphs[at][0], at + 1
        while end < len(graphs) and graphs[end][0] == n and (end - at + 1) * n * n <= cells:
            end += 1
        stack = np.full((end - at, n, n), empty)
        for k, (_, _, _, a, b, x) in enumerate(graphs[at:end]):
            combine.at(stack[k], (a, b), x)
            combine.at(stack[k], (b, a), x)
        stack[:, np.arange(n), np.arange(n)] = empty
        rows = edges[group_cols].iloc[np.repeat([first[i] for _, i, *_ in graphs[at:end]], n)].reset_index(drop=True)
        rows["node"] = np.concatenate([names for _, _, names, *_ in graphs[at:end]])
        yield stack, rows
        at = end


def numbered_graphs(edges: pd.DataFrame, group_cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """The graphs of a frame of edges (group…, src, dst, w; groups complete) as one graph without links between them: (src, dst
    and w of every edge in both directions, the first node of each graph, group columns and ``node`` as a frame).
    Nodes are numbered through, those of a graph together."""
    group = edges.groupby(group_cols, sort=False, dropna=False).ngroup().to_numpy()
    codes, labels = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
    keys, at = np.unique(np.concatenate([group, group]) * len(labels) + codes, return_inverse=True)
    of, first_row = keys // len(labels), np.unique(group, return_index=True)[1]
    nodes = edges[group_cols].iloc[first_row[of]].reset_index(drop=True)
    nodes["node"] = np.asarray(labels)[keys % len(labels)]
    a, b, w = at[: len(edges)], at[len(edges):], edges["w"].to_numpy(np.float64)
    first = np.searchsorted(of, np.arange(len(first_row)))
    return np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), first, nodes
