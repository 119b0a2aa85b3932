"""Entity preparation, prompts, filters, lookups and resume joins (B and C families).

All operators are column expressions, equi/semi/anti joins and aggregations.
Per-key "keep first" and per-group subsets avoid one-task-per-key windows:
"first" is a ``min_by(row, order)`` aggregation (map-side partial), and
per-group top-k is computed per (group, salt) before a final per-group cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import cut_lineage

# Fixed templates and values (must equal the original's for identical prompts).
ENTITY_QUESTION = "Write a few paragraphs on '{a}'."
BOOK_QUESTION = "Write a few paragraphs about the book '{t}' written by {a} in the year {pubdate}."
BOOK_ENTITY = "{t} written by {a} in the year {pubdate}"
EMBED_HEADER = "The following is an excerpt from a text about: '{entity}' \n\n {text}"
EMBED_TASK_PREFIX = "clustering: "          # added for model names containing 'nomic'
LONG_DATE = "MMMM d, yyyy"
MIN_TEXT_CHARS = 5000
DATE_CUTOFF = "2000-01-01"
MIN_RESPONSE_CHARS = 100
SIMILARITY_THRESHOLD = 0.75

# Our own generation-prompt wording (the original's text is not reproduced).
GENERATION_PROMPT = (
    "{system}\n\nAnswer the open-ended question given between <question> tags in about {word_count} words. "
    "Put the whole answer between one <response> and one </response> tag and use no other tags.\n\n"
    "<question>{question}</question>\n"
)
DEFAULT_SYSTEM = "You write accurate, well-formatted answers to open-ended questions."


def fill(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders of a template string with columns (a ``concat``)."""
    parts: list[Column] = []
    rest = template
    while rest:
        starts = [(rest.find("{" + k + "}"), k) for k in cols if rest.find("{" + k + "}") >= 0]
        if not starts:
            parts.append(F.lit(rest))
            break
        pos, key = min(starts)
        if pos:
            parts.append(F.lit(rest[:pos]))
        parts.append(cols[key].cast("string"))
        rest = rest[pos + len(key) + 2:]
    return F.concat(*parts) if parts else F.lit("")


# ---------------------------------------------------------------- B1–B8 text building

def entity_question(entity: Column) -> Column:
    """B1 (entity form)."""
    return fill(ENTITY_QUESTION, a=entity)


def book_question(title: Column, author: Column, pubdate: Column) -> Column:
    """B1 (book form)."""
    return fill(BOOK_QUESTION, t=title, a=author, pubdate=pubdate)


def book_entity(title: Column, author: Column, pubdate: Column) -> Column:
    """Entity string with single quotes removed from title and author."""
    return fill(BOOK_ENTITY, t=F.replace(title, F.lit("'"), F.lit("")),
                a=F.replace(author.cast("string"), F.lit("'"), F.lit("")), pubdate=pubdate)


def generation_prompt(question: Column, word_count: int | Column, system: str = DEFAULT_SYSTEM) -> Column:
    """B2: generation prompt from a question, a system text and a word count."""
    wc = word_count if isinstance(word_count, Column) else F.lit(word_count)
    return fill(GENERATION_PROMPT, system=F.lit(system), word_count=wc, question=question)


def replicate(df: DataFrame, n: int | Column, col: str = "sample_idx") -> DataFrame:
    """N copies of each row, numbered 0..n-1."""
    nn = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), nn - 1))).filter(nn > 0)


def judge_prompt(template: str, entity: Column, reference_doc: Column, response: Column) -> Column:
    """Judge prompt from a user template with {entity}, {reference_doc}, {response}."""
    return fill(template, entity=entity, reference_doc=reference_doc, response=response)


def numbered_statements(statements: Column) -> Column:
    """B5: '1. <statement>…</statement>' lines, 1-based."""
    return F.array_join(F.transform(statements, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". <statement>"), s,
                                                                     F.lit("</statement>"))), "\n")


def embed_header(entity: Column, text: Column, model_name: str = "") -> Column:
    """Embedding header (task prefix for one model family)."""
    h = fill(EMBED_HEADER, entity=entity, text=text)
    return F.concat(F.lit(EMBED_TASK_PREFIX), h) if "nomic" in model_name else h


def entity_from_question(question: Column) -> Column:
    """Text after the first single quote, quotes dropped, trailing dots stripped, trimmed."""
    after = F.substring(question, F.instr(question, "'") + 1, F.length(question))
    return TX.strip(F.regexp_replace(F.replace(after, F.lit("'"), F.lit("")), "\\.+$", ""))


# ---------------------------------------------------------------- B9–B14 filters

def parse_mixed_date(text: Column, formats: list[str]) -> Column:
    """First format that parses wins; unparseable → null (coerce)."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def long_date(ts: Column) -> Column:
    return F.date_format(ts, LONG_DATE)


def ambiguity_flags(entities: DataFrame, entity_col: str, first_names: DataFrame, places: DataFrame) -> DataFrame:
    """B11 + B12: flag single-word entities that are a common first name, or an ambiguous
    place (in the list, or ending in 'burg' with length > 4). Lists are user tables with a
    ``name`` column; Spark chooses the join by their measured bytes."""
    norm = F.lower(F.trim(F.col(entity_col)))
    one_word = F.size(F.split(norm, "\\s+")) == 1
    e = entities.withColumn("_n", norm)
    fn = first_names.select(F.lower(F.trim("name")).alias("_n")).distinct().withColumn("_fn", F.lit(True))
    pl = places.select(F.lower(F.trim("name")).alias("_n")).distinct().withColumn("_pl", F.lit(True))
    e = e.join(fn, "_n", "left").join(pl, "_n", "left")
    first = one_word & F.coalesce("_fn", F.lit(False))
    place = one_word & (F.coalesce("_pl", F.lit(False)) | (F.col("_n").endswith("burg") & (F.length("_n") > 4)))
    return e.withColumn("is_first_name", first).withColumn("is_ambiguous_place", place).drop("_n", "_fn", "_pl")


def split_valid(df: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Split on a predicate; the reject side carries ``reason``."""
    flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return (flagged.filter("_ok").drop("_ok"),
            flagged.filter(~F.col("_ok")).drop("_ok").withColumn("reason", F.lit(reason)))


# ---------------------------------------------------------------- B17–B20 dedupe, index, sampling

def keep_first(df: DataFrame, subset: list[str], order_cols: list[str]) -> DataFrame:
    """One row per ``subset`` key – the first in ``order_cols`` order (order-stable)."""
    others = [c for c in df.columns if c not in subset]
    # only the order columns are compared, so the row may hold maps and long texts
    g = df.groupBy(*subset).agg(F.min_by(F.struct(*[F.col(c).alias(f"_v_{c}") for c in others]), F.struct(*order_cols)).alias("_f"))
    return g.select(*subset, *[F.col(f"_f._v_{c}").alias(c) for c in others]).select(*df.columns)


def _ranged(df: DataFrame, order_cols: list[str], n_parts: int | None) -> DataFrame:
    """``df`` in sorted ranges with ``_pid`` and the row number ``_local`` in it, evaluated once.

    The ranges come from a sample, which differs from plan to plan, so both columns are fixed by a
    checkpoint: row numbers and offsets must come from one evaluation.
    """
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn("_pid", F.spark_partition_id())
    return cut_lineage(s.withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))


def dense_index(df: DataFrame, order_cols: list[str], col: str = "row_idx", n_parts: int | None = None) -> DataFrame:
    """Dense 0-based index in ``order_cols`` order without a single-partition window.

    Range-partition and sort, number rows inside each partition, then add the
    partition's offset from a per-partition count table (one row per partition).
    ``order_cols`` must be unique (ties would make the numbering order-dependent).
    """
    s = _ranged(df, order_cols, n_parts)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(offsets.select("_pid", "_off")), "_pid").withColumn(
        col, (F.col("_off") + F.col("_local")).cast("long")).drop("_pid", "_local", "_off")


def hash_order(cols: list[str], seed: int) -> Column:
    """Order by the MD5 digest of the seed and the key as text (the same in any SQL engine)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_rows(df: DataFrame, key_cols: list[str], n: int, seed: int = 0) -> DataFrame:
    """Deterministic dataset-level subset of n rows (smallest seeded hashes)."""
    return df.withColumn("_h", hash_order(key_cols, seed)).orderBy("_h", *key_cols).limit(n).drop("_h")


def group_subset(df: DataFrame, group_cols: list[str], item_col: str, k: int, seed: int = 0,
                 salts: int = 16) -> DataFrame:
    """K of K items per group by seeded hash order, keeping the chosen item ids.

    Two stages: top-k per (group, salt) – so a hot group is cut by many tasks –
    then top-k per group over at most k × salts survivors.
    """
    h = hash_order(group_cols + [item_col], seed)
    d = df.withColumn("_h", h).withColumn("_salt", F.pmod(F.xxhash64(F.col(item_col), F.lit(seed + 1)), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy("_h", item_col)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy("_h", item_col)
    return d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_h", "_salt", "_r")


# ---------------------------------------------------------------- C1–C10 lookups and resume

def attach_reference(groups: DataFrame, docs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Equi-join groups to their reference document; groups without one are rejected."""
    return (groups.join(docs, keys, "inner"),
            groups.join(docs.select(*keys), keys, "left_anti").withColumn("reason", F.lit("no reference document")))


def title_position(titles: Column, entity: Column) -> Column:
    """0-based index of the first title equal to the entity (lower, trimmed); −1 if none."""
    return (F.array_position(F.transform(titles, lambda t: F.lower(F.trim(t))), F.lower(F.trim(entity))) - 1).cast("int")


def page_text(contexts: Column, idx: Column) -> Column:
    """The context at a matched index (null when unmatched)."""
    return F.when(idx >= 0, F.element_at(contexts, idx + 1))


def title_alias_overlap(titles: Column, aliases: Column) -> Column:
    """C4: lower-cased titles ∩ lower-cased aliases."""
    return F.array_intersect(F.transform(titles, lambda t: F.lower(t)), F.transform(aliases, lambda t: F.lower(t)))


def keep_keys(df: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows whose key appears in the key set."""
    return df.join(keys.select(*key_cols).distinct(), key_cols, "left_semi")


def drop_done(df: DataFrame, done: DataFrame, key_cols: list[str]) -> DataFrame:
    """Remove already-processed keys."""
    return df.join(done.select(*key_cols), key_cols, "left_anti")


def incomplete_keys(expected: DataFrame, existing: DataFrame, key_cols: list[str], n_expected: str) -> DataFrame:
    """Keys that are absent from, or short in, the existing output (``have < expected``)."""
    have = existing.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("have"))
    j = expected.join(have, key_cols, "left").fillna({"have": 0})
    return j.filter(F.col("have") < F.col(n_expected))


def shortfall(expected: DataFrame, existing: DataFrame, key_cols: list[str], n: int | str) -> DataFrame:
    """Per key, ``greatest(n − have, 0)`` more samples, as replicated rows."""
    have = existing.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("have"))
    nn = F.col(n) if isinstance(n, str) else F.lit(n)
    j = expected.join(have, key_cols, "left").fillna({"have": 0}).withColumn(
        "missing", F.greatest(nn - F.col("have"), F.lit(0)))
    return replicate(j, F.col("missing"), "sample_idx")


def remap_aliases(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """Replace keys found in an alias table ``(alias, canonical)``; others unchanged."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return df.join(a, F.col(col) == F.col("_a"), "left").withColumn(col, F.coalesce("_c", col)).drop("_a", "_c")


def number_within_groups(df: DataFrame, key_cols: list[str], order_cols: list[str], col: str = "rn",
                         n_parts: int | None = None) -> DataFrame:
    """0-based row number per key in ``order_cols`` order, exact, without a per-key window.

    Range-partition and sort by (key, order): a hot key spans many partitions. Inside a
    partition a key's rows are contiguous; the key's offset in a partition is its row count in
    earlier partitions, from a count table with one row per (partition, key). Null keys are keys
    of their own. ``key_cols + order_cols`` must be unique.
    """
    s = _ranged(df, [*key_cols, *order_cols], n_parts)
    per = s.groupBy(*key_cols, "_pid").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*key_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    per = per.select(*[F.col(c).alias(f"_k_{c}") for c in key_cols], F.col("_pid").alias("_p"), "_first", "_off")
    same = F.col("_pid") == F.col("_p")
    for c in key_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return s.join(per, same).withColumn(col, (F.col("_off") + F.col("_local") - F.col("_first")).cast("long")).drop(
        "_pid", "_local", "_first", "_off", "_p", *[f"_k_{c}" for c in key_cols])
