"""Connected components of an edge table by alternating star contraction.

Each round turns every vertex's edges to its least neighbour (first for larger, then for smaller
neighbours). The edges become stars whose centres are the components' least vertices, in about
log^2 n rounds. A round is two joins on slim rows with map-side minima, so a hub is no group in one
task; lineage is cut with a checkpoint in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) for every vertex of ``edges(u, v)``; ``root`` is the least id of its component."""
    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: a vertex's larger neighbours go to its least one. The table of least neighbours is
        # cut off, so that both sides of the join are shuffled for it and a hub's edges can be split.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = cut_lineage(e.join(least, "v").select("u", F.col("m").alias("v")).distinct())
        # small star: its smaller neighbours, and the vertex itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut_lineage(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
