"""K-d tree sharding: shards of near-equal bytes from recursive weighted medians over metadata.

Points are groups of equal texts, weighted with their bytes, so copies share a shard; a group of more
than ``max_group`` of a shard's bytes is dealt into parts by doc_id hash, else shards could not be near
equal. Dimensions are the size (logarithm), hashed positions of the metadata columns, and two digests
of the text, each scaled to the whole table's range. A node that still holds more than one shard's
bytes is cut along its widest dimension at the weighted median (for an odd number of shards, the
share of the smaller half). Medians come from one distributed histogram of ``bins`` bins per node and
dimension; a dimension whose best cut misses the median by more than ``tolerance`` of the node's
bytes (few distinct values) yields to the next widest.

The driver sees a row per tree node and dimension, never data. All rows are kept; null texts count as
empty, null metadata as an empty string; rows without an id sort first in their shard; repeated rows
take slots of their own; an empty table gives no rows. Shards may be empty where there are fewer
groups than shards. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prep import number_within_groups
from .common import crc32_text, prepare, stored, text_key


def _position(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 52)).cast("double")


def _slim(docs: DataFrame, metadata: list[str]) -> DataFrame:
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc32_text(F.col("text")).alias("text_crc32"),
                       text_key(F.col("text")).alias("text_key"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"m_{c}") for c in metadata])


def _cuts(points: DataFrame, dims: list[str], nodes: dict[int, tuple], bins: int) -> dict[int, list[tuple]]:
    """Per node with more than one shard: (width, error as a share, dimension, bin of the cut) per dimension."""
    spark = points.sparkSession
    ranges = points.groupBy("node").agg(F.sum("w").alias("total"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims])
    rows = [r.asDict() for r in ranges.collect()]
    open_rows = [(r["node"], d, r[f"lo_{d}"], r[f"hi_{d}"], float(r["total"]), (nodes[r["node"]][1] // 2) / nodes[r["node"]][1])
                 for r in rows if nodes[r["node"]][1] > 1 for d in dims if r[f"hi_{d}"] > r[f"lo_{d}"]]
    if not open_rows:
        return {}
    table = spark.createDataFrame(open_rows, "node int, dim string, lo double, hi double, total double, share double")
    each = points.select("node", "w", F.explode(F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))])).alias("dim", "v"))
    each = each.join(F.broadcast(table), ["node", "dim"])  # a row per node and dimension
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = each.groupBy("node", "dim", "lo", "hi", "total", "share", at.alias("bin")).agg(F.sum("w").alias("w"))
    w = Window.partitionBy("node", "dim").orderBy("bin")
    hist = hist.withColumn("below", F.sum("w").over(w)).withColumn("last", F.lead("bin").over(w).isNull())
    error = F.abs(F.col("below") / F.col("total") - F.col("share"))
    best = hist.filter("not last").groupBy("node", "dim", "lo", "hi").agg(F.min(F.struct(error.alias("e"), F.col("bin"))).alias("b"))
    found: dict[int, list[tuple]] = {}
    for r in best.collect():
        found.setdefault(r.node, []).append((r.hi - r.lo, r.b.e, r.dim, r.lo, r.hi, r.b.bin))
    return found


def kd_tree(points: DataFrame, dims: list[str], shards: int, bins: int = 4096, tolerance: float = 0.002) -> DataFrame:
    """``points`` (w, dims scaled to 0..1) with ``node``: the shard number of each."""
    spark = points.sparkSession
    points, nodes = points.withColumn("node", F.lit(0)), {0: (0, shards)}  # node -> (first shard, shards)
    while any(k > 1 for _, k in nodes.values()):
        cuts, splits, after = _cuts(points, dims, nodes, bins), [], {}
        for node, (first, k) in nodes.items():
            choice = sorted(cuts.get(node, []), key=lambda c: (-round(c[0], 6), dims.index(c[2])))
            if k == 1 or not choice:
                after[first] = (first, 1)
                splits.append((node, first, first, None, 0.0, 1.0, 0))
                continue
            cut = next((c for c in choice if c[1] <= tolerance), min(choice, key=lambda c: c[1]))
            left = k // 2
            after[first], after[first + left] = (first, left), (first + left, k - left)
            splits.append((node, first, first + left, *cut[2:]))
        table = spark.createDataFrame(splits, "node int, low int, high int, dim string, lo double, hi double, cut int")
        value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims], F.lit(0.0))
        at = F.least(F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        points = points.join(F.broadcast(table), "node").withColumn("next", F.when(F.col("dim").isNull() | (at <= F.col("cut")), F.col("low")).otherwise(F.col("high")))
        points = points.drop("node", "low", "high", "dim", "lo", "hi", "cut").withColumnRenamed("next", "node")
        nodes = after
    return points


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, metadata: tuple[str, ...] = ("lang", "source"),
          max_group: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, text_key, shard, slot (gapless per shard, by doc_id)."""
    prepare(docs.sparkSession)
    names = [c for c in metadata if c in docs.columns]
    rows = stored(_slim(docs, names), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("w"), F.min("size").alias("size"), *[F.min(f"m_{c}").alias(f"m_{c}") for c in names])
    # at most shards / max_group groups are that heavy
    heavy = groups.filter(F.col("w") > F.lit(max_group * total / shards)).select(
        "text_key", F.ceil(F.col("w") / F.lit(max_group * max(total, 1) / shards / 4)).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    rows = rows.join(F.broadcast(heavy), "text_key", "left").select(*rows.columns, part)
    points = rows.groupBy("text_key", "part").agg(F.sum("size").alias("w"), F.min("size").alias("size"), *[F.min(f"m_{c}").alias(f"m_{c}") for c in names])
    raw = {"d_size": F.log2("size"), **{f"d_{c}": _position(F.col(f"m_{c}")) for c in names},
           "d_digest": F.pmod(F.xxhash64("text_key", "part"), F.lit(1 << 52)).cast("double"),
           "d_digest2": F.pmod(F.xxhash64("part", "text_key", F.lit(2)), F.lit(1 << 52)).cast("double")}
    points = stored(points.select("text_key", "part", "w", *[v.alias(k) for k, v in raw.items()]), "points")
    whole = points.agg(*[f(d).alias(f"{d}_{f.__name__}") for d in raw for f in (F.min, F.max)]).first()
    scaled = {}
    for d in raw:
        lo, hi = whole[f"{d}_min"] or 0.0, whole[f"{d}_max"] or 0.0
        scaled[d] = (F.col(d) - lo) / (hi - lo if hi > lo else 1.0)
    placed = kd_tree(points.select("text_key", "part", "w", *[v.alias(k) for k, v in scaled.items()]), [*raw], shards)
    out = rows.join(placed.select("text_key", "part", F.col("node").alias("shard")), ["text_key", "part"])
    return number_within_groups(out.select("doc_id", "size", "text_crc32", "text_key", "shard"), ["shard"], ["doc_id", "text_key"], "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` with their shard and slot, a folder per shard, sorted by slot."""
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    own = placed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "shard", "slot")
    n = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("slot"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text_key").orderBy("doc_id"))
    rows = keyed.withColumn("_n", nth).join(own.withColumn("_m", n), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")) & (F.col("_n") == F.col("_m")))
    rows.drop("_id", "_key", "_n", "_m", "_text_key").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
