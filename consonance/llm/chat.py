"""Chat formatting in budgeted windows, with a loss mask.

Turns of a conversation are measured in tokens (words, numbers and marks, plus ``OVERHEAD`` for the
template). Prefix sums of the turn tokens choose spans that begin and end at turns: with a stride of half the
budget (less the system turn; an eighth of the budget at least), the turns whose prefix sum ends in the same
stride form a span, and a turn longer than a stride is a span of its own. So a window stays in its budget unless one
turn alone, or the system turn with what it leaves, exceeds it. A window repeats the system turn and as much of the turns before it as ``history``
tokens and its own budget allow; then come its own turns. The mask covers the texts of
its own assistant turns only, so repeated targets are masked out and each is learnt once.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and texts, backslashes are doubled
and a backslash is put after the first character of every control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), so no control string of a text survives and the text can
be restored exactly.

Everything is Spark SQL. Turns are numbered over range partitions and prefix sums are made in three levels (blocks of
numbers, blocks of blocks, a conversation), and history is an equi-join on ranges of prefix sums, so a very long conversation is
spread over tasks; rows that hold text are windows, whose size the budget bounds.

Null text counts as empty, a null role as an empty role, a null turn as -1; rows without a conversation id
form a conversation; turns with equal numbers are ordered by role and text; repeated rows are
turns of their own; an empty table gives no windows. A conversation's first system turn is repeated in every
later window, however long it is. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prep import number_within_groups
from .common import prepare, stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates (their first character, what follows it).
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
OVERHEAD = 4
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(a: str, b: str, *cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _measured(turns: DataFrame) -> DataFrame:
    """Turns with tokens, their place, and the prefix sum up to and with each."""
    t = turns.select(
        F.col("conv_id"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(TOKENS)).cast("long") + OVERHEAD)
    t = t.withColumn("row", F.monotonically_increasing_id())  # equal rows can be split, too
    t = number_within_groups(t, ["conv_id"], ["turn", "role", "text", "row"], "place").withColumn("place", F.col("place") + 1)
    t = t.withColumn("block", F.floor(F.col("place") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("upto", F.sum("tokens").over(inside))
    blocks = t.groupBy("conv_id", "block").agg(F.sum("tokens").alias("s")).withColumn("large", F.floor(F.col("block") / BLOCK))
    larges = blocks.groupBy("conv_id", "large").agg(F.sum("s").alias("s"))
    before = lambda keys, order: F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("conv_id", "large", "block", before(["conv_id", "large"], "block").alias("s0"))
    larges = larges.select("conv_id", "large", before(["conv_id"], "large").alias("s1"))
    blocks = blocks.alias("a").join(larges.alias("b"), _same("a", "b", "conv_id", "large")).select("a.conv_id", "block", (F.col("s0") + F.col("s1")).alias("s0"))
    return t.alias("a").join(blocks.alias("b"), _same("a", "b", "conv_id", "block")).select(
        "a.conv_id", "role", "text", "tokens", (F.col("upto") + F.col("s0")).alias("upto"), "place")


def windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """(conv_id, window, n_repeated, n_tokens, formatted, mask); ``mask`` lists [start, end) in code points."""
    prepare(turns.sparkSession)
    t = stored(_measured(turns), "turns")
    system = t.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("place", "tokens", "role", "text")).alias("sys"))
    # a system turn may be repeated in every window of its conversation: only its size is joined to the turns
    sizes = system.select("conv_id", F.col("sys.tokens").alias("extra"), F.col("sys.place").alias("sys_place"))
    extra = F.coalesce(F.col("extra"), F.lit(0)).cast("long")
    t = t.alias("a").join(sizes.alias("b"), _same("a", "b", "conv_id"), "left").select("a.conv_id", "role", "text", "tokens", "upto", "place", extra.alias("extra"), "sys_place")
    stride = F.greatest(F.floor((F.lit(budget) - F.col("extra")) / 2), F.lit(max(budget // 8, 1)))
    t = t.withColumn("window", 2 * F.floor((F.col("upto") - 1) / stride) + F.when(F.col("tokens") > stride, 0).otherwise(1))
    spans = t.groupBy("conv_id", "window").agg(
        F.min(F.col("upto") - F.col("tokens")).alias("begin"), F.min("place").alias("first"), F.sum("tokens").alias("own"),
        F.first("extra").alias("extra"), F.first("sys_place").alias("sys_place"))
    left = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("own") - F.col("extra")))
    spans = spans.withColumn("room", left)
    turn = lambda rank: F.struct(F.lit(rank).alias("rank"), "place", "role", "text", "tokens").alias("turn")
    own = t.select("conv_id", "window", turn(2))
    # history: turns that begin at most ``room`` tokens before the window
    reach = F.sequence(F.floor((F.col("begin") - F.col("room")) / history), F.floor(F.col("begin") / history))
    asked = spans.filter("begin > 0 and room > 0").select("conv_id", "window", "begin", "room", "first", F.explode(reach).alias("slice"))
    told = t.select("conv_id", "place", "role", "text", "tokens", "upto", "sys_place", F.floor(F.col("upto") / history).alias("slice"))
    before = told.alias("a").join(asked.alias("b"), _same("a", "b", "conv_id", "slice")).filter(
        (F.col("place") < F.col("first")) & (F.col("begin") - (F.col("upto") - F.col("tokens")) <= F.col("room")) & ~F.col("place").eqNullSafe(F.col("sys_place")))
    before = before.select("a.conv_id", "window", turn(1))
    kept = spans.filter("first > sys_place").select("conv_id", "window").alias("a").join(system.alias("b"), _same("a", "b", "conv_id")).select(
        "a.conv_id", "window", F.struct(F.lit(0).alias("rank"), "sys.place", "sys.role", "sys.text", "sys.tokens").alias("turn"))
    rows = own.unionByName(before).unionByName(kept).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return stored(_rendered(rows), "chat-windows")


def _rendered(rows: DataFrame) -> DataFrame:
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"),
        ((t["rank"] == 2) & (t["role"] == "assistant")).alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        z = a + F.length(p["body"])
        mask = F.when(p["learn"], F.concat(acc["mask"], F.array(F.struct(a.alias("start"), z.alias("end"))))).otherwise(acc["mask"])
        return F.struct((z + len(END)).alias("at"), mask.alias("mask"))

    out = rows.select("conv_id", "window", F.size(F.filter("turns", lambda t: t["rank"] < 2)).alias("n_repeated"),
                      F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.select("conv_id", "window", "n_repeated", "n_tokens", text.alias("formatted"), F.aggregate("parts", start, step, lambda a: a["mask"]).alias("mask"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """Per window, from its text and mask alone: its own turns (role, text) and the text under the mask, restored."""
    whole = F.split("formatted", r"<\|end\|>")
    own = F.slice(whole, F.col("n_repeated") + 1, F.size(whole) - 1 - F.col("n_repeated"))
    pieces = F.transform(own, lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|text\|>"))
    turns = F.transform(pieces, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    learnt = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss text and their SHA-256."""
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = read_windows(formatted).select("conv_id", F.size("turns").alias("n"), F.struct("window", spelt.alias("spelt"), "learnt").alias("w"), F.length("learnt").alias("loss"), "chars")
    c = w.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("loss").cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    joined = lambda field: F.sha2(F.array_join(F.transform("ws", lambda x: x[field]), ""), 256)
    return c.select("conv_id", "n_turns", joined("spelt").alias("turns_sha256"), "loss_chars", joined("learnt").alias("loss_sha256"), "formatted_chars")
