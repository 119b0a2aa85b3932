"""Ranked lexical search for many items at once, common parts of the items evaluated once.

A document's score for an item is a sum over the item's terms of values that depend on the term and the
document only. So sums over term sets that several items share are computed once per document:

* Mining (``query_dag``): terms that occur in the same items form one group. Pairs of groups that two or more
  items hold become a node, the most frequent first, and take the pair's place in those items; this is repeated with
  nodes as parts until no pair is shared. The result is a DAG whose sources are groups and whose sinks are
  items; each node is the sum of two earlier ones. Long items are mined in runs of ``RUN`` parts, so
  mining takes time in proportion to the items' terms.
* Postings: one pass over the texts writes, per document, its number of terms and those of the items' vocabulary
  with their counts. From them come the corpus statistics, over all documents.
* Evaluation: tasks read the postings in batches; term values are added up into the groups' accumulators
  (one per document and group), nodes are summed level by level, items from their last parts. All sums are
  64-bit integers. A task keeps the ``k`` best documents per item, which are merged over tasks in two steps.

Items are put together by equal term sets first. Different sets are worked on in slices whose expected
number of terms is ``slice_terms``; only a slice's vocabulary and DAG go to the driver and the tasks. Words are
compared by 64-bit hashes.

Null texts and texts without terms are not counted and found by nothing; items without terms find nothing; repeated
documents and items are documents and items of their own; documents without an id come last among equal
scores. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, stored, text_bytes, words
from .topk import TopK, best

RUN = 64
CELLS = 4_000_000
NO_ID = np.iinfo(np.int64).max


def _item_terms(batches):
    """Distinct term hashes of each item, sorted."""
    for batch in batches:
        _, _, h, first = words(*text_bytes(batch.column(1)))
        sets = [np.unique(h[a:z]).view(np.int64) for a, z in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "terms"])


class QueryDag:
    """``group_of``: group of each term; ``levels``: arrays (left, right) of the nodes of each level, numbered on
    from the groups; ``parts``/``begin``: the nodes whose sum is each item."""

    def __init__(self, group_of: np.ndarray, n_groups: int, levels: list[tuple[np.ndarray, np.ndarray]], items: list[list[int]]):
        self.group_of, self.n_groups, self.levels = group_of, n_groups, levels
        self.n_nodes = n_groups + sum(len(left) for left, _ in levels)
        self.parts = np.array([p for item in items for p in item], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(item) for item in items])[:-1]]).astype(np.int64)
        self.n_items = len(items)

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents) sums of ``value`` over each item's terms; ``doc`` is the document's place."""
        acc = np.zeros((self.n_nodes, n_docs), np.int64)
        np.add.at(acc, (self.group_of[term], doc), value)
        at = self.n_groups
        for left, right in self.levels:
            acc[at: at + len(left)] = acc[left] + acc[right]
            at += len(left)
        return np.add.reduceat(acc[self.parts], self.begin, axis=0)


def query_dag(items: list[np.ndarray], n_terms: int) -> QueryDag:
    """The DAG of items given as arrays of term numbers (none empty); every term is in some item."""
    holders = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms.tolist():
            holders[t].append(i)
    groups, group_of = {}, np.zeros(n_terms, np.int64)
    for t, held in holders.items():
        group_of[t] = groups.setdefault(tuple(held), len(groups))
    shared = np.zeros(len(groups), np.int64)
    for held, g in groups.items():
        shared[g] = len(held)
    # frequent parts first, so that runs of long items hold the parts that others share
    parts = [sorted(set(group_of[terms].tolist()), key=lambda g: (-shared[g], g)) for terms in items]
    n, levels = len(groups), []
    while True:
        counts: Counter = Counter()
        for p in parts:
            for at in range(0, len(p), RUN):
                counts.update(combinations(sorted(p[at: at + RUN]), 2))
        wanted = sorted((pair for pair, c in counts.items() if c > 1), key=lambda pair: (-counts[pair], pair))
        if not wanted:
            return QueryDag(group_of, len(groups), levels, parts)
        at_of = defaultdict(set)
        for i, p in enumerate(parts):
            for g in p:
                at_of[g].add(i)
        made = []
        for a, b in wanted:
            both = at_of[a] & at_of[b]
            if len(both) < 2:
                continue
            for i in both:
                at_of[a].discard(i)
                at_of[b].discard(i)
                parts[i] = [g for g in parts[i] if g != a and g != b] + [n + len(made)]
            made.append((a, b))
        levels.append((np.array([a for a, _ in made]), np.array([b for _, b in made])))
        n += len(made)


def _postings(vocabulary):
    """doc_id, number of terms, and the vocabulary's terms in it with their counts; texts without terms are left out."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            _, _, h, first = words(*text_bytes(batch.column(1)))
            n = np.diff(first)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            doc = np.repeat(np.arange(len(n)), n)[hit]
            key, count = np.unique(doc * len(known) + at[hit], return_counts=True)
            term, cut = (key % max(len(known), 1)).astype(np.int32), np.searchsorted(key, np.arange(len(n) + 1) * len(known))
            some = np.flatnonzero(n)
            terms = [term[cut[i]: cut[i + 1]].tobytes() for i in some]
            counts = [count[cut[i]: cut[i + 1]].astype(np.int32).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "terms", "counts"])

    return run


def _document_counts(n_terms: int):
    """Partial document frequencies of a task."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                df[np.frombuffer(raw, np.int32)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    return run


def _ranked(plan, n_docs: int, n_words: int, k: int):
    """The ``k`` best documents per item of a task's postings."""

    def run(batches):
        dag, weight = plan.value
        top = TopK(dag.n_items, k, 1)
        step = max(1, CELLS // (dag.n_nodes + len(dag.parts)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = batch.column(0).fill_null(NO_ID).to_numpy()
                n = batch.column(1).to_numpy()
                each = [np.frombuffer(raw, np.int32) for raw in batch.column(2).to_pylist()]
                term = np.concatenate(each)
                tf = np.concatenate([np.frombuffer(raw, np.int32) for raw in batch.column(3).to_pylist()]).astype(np.int64)
                doc = np.repeat(np.arange(len(each)), [len(t) for t in each])
                m = 50 + (50 * n * n_docs) // n_words
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                scores = dag.scores(term, doc, value, len(each))
                item, place = np.nonzero(scores >= top.floor[:, None])
                top.add(item, scores[item, place], ids[place])
        item, score, ids = top.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _slice(spark, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame | None:
    """(set_key, rank, doc_id, score) for the term sets of one slice."""
    rows = sets.collect()  # bounded by the slice
    if not rows:
        return None
    items = [np.array(r.terms, np.int64).view(np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(items))
    sc = spark.sparkContext
    postings = stored(docs.select("doc_id", "text").mapInArrow(released(_postings(sc.broadcast(vocabulary))), "doc_id long, n long, terms binary, counts binary"), "postings")
    n_docs, n_words = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select("terms").mapInArrow(_document_counts(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    dag = query_dag([np.searchsorted(vocabulary, terms) for terms in items], len(vocabulary))
    scored = postings.mapInArrow(released(_ranked(sc.broadcast((dag, weight)), n_docs, max(n_words, 1), k)), "item long, doc_id long, score long")
    found = stored(scored.withColumn("task", F.spark_partition_id()), "ranked")
    tasks = found.select(F.max("task")).first()[0] or 0
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    top = best(found, ["item"], k, order, "task", math.isqrt(tasks + 1))
    names = spark.createDataFrame([(i, bytes(r.set_key)) for i, r in enumerate(rows)], "item long, set_key binary")
    return top.join(names, "item").select("set_key", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, slice_terms: int = 65_536) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<long>")
    keyed = stored(terms.filter(F.size("terms") > 0).withColumn("set_key", F.unhex(F.md5(F.array_join(F.transform("terms", lambda t: t.cast("string")), ",").cast("binary")))), "item-terms")
    sets = stored(keyed.groupBy("set_key").agg(F.first("terms").alias("terms")), "item-sets")
    total = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    slices = -(-total // slice_terms)
    part = F.pmod(F.xxhash64("set_key"), F.lit(max(slices, 1)))
    found = [x for i in range(slices) if (x := _slice(spark, docs, sets.filter(part == i), k)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return keyed.select("item_id", "set_key").join(whole, "set_key").select("item_id", "rank", "doc_id", "score")
