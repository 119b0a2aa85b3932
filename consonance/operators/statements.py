"""Text → statements, tokens and probabilities (D family), as column jobs.

Every operator takes and returns DataFrames; per-response work stays inside
array expressions or windows partitioned by one response (one text), so no
task ever holds more than a response's own statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX

# Fixed patterns of the judge output format.
PAIR_PATTERN = r"<statement>(.*?)</statement>\s*<class>(1|0)</class>"
STATEMENT_TAG_PATTERN = r"<statement>(.*?)</statement>"
LABEL_LIST_PATTERN = r"\d+\.\s*(True|False)"
CLASS_WINDOW = 7   # tokens looked at before / after a class token
UNIX_LINES = "(?d)"  # only a newline ends a line for "." (a carriage return does not)


# ---------------------------------------------------------------- statements

def split_statements(responses: DataFrame, key_cols: list[str], text_col: str = "response") -> DataFrame:
    """Statements of each response: ``(key…, statement_idx, text)``."""
    return responses.select(*key_cols, F.posexplode(TX.statements(F.col(text_col))).alias("statement_idx", "text"))


def parse_tagged(df: DataFrame, key_cols: list[str], text_col: str) -> tuple[DataFrame, DataFrame]:
    """D1 + D2: ordered (statement, class) pairs from tagged judge output.

    A response whose number of ``<statement>`` tags differs from the number of
    complete statement/class pairs is rejected as a whole (reason column).
    """
    t = F.col(text_col)
    stmts = F.regexp_extract_all(t, F.lit(UNIX_LINES + PAIR_PATTERN), 1)
    classes = F.regexp_extract_all(t, F.lit(UNIX_LINES + PAIR_PATTERN), 2)
    n_tags = F.size(F.regexp_extract_all(t, F.lit(UNIX_LINES + STATEMENT_TAG_PATTERN), 1))
    # one-row inline (a Generate node): the ok / not-ok filters below are not pushed
    # down with the three regex extractions copied into them
    flagged = df.select(*key_cols, F.inline(F.array(F.struct(t.alias("_t"), stmts.alias("_s"), classes.alias("_c"),
                                                             n_tags.alias("_n")))))
    ok = F.size("_s") == F.col("_n")
    good = flagged.filter(ok).select(
        *key_cols, F.posexplode(F.arrays_zip(F.col("_s").alias("s"), F.col("_c").alias("c"))).alias("statement_idx", "p"))
    good = good.select(*key_cols, "statement_idx", TX.strip(F.col("p.s")).alias("text"),
                       (F.col("p.c") == "1").alias("class"))
    bad = flagged.filter(~ok).select(*key_cols, F.col("_t").alias(text_col),
                                     F.lit("statement/class tag mismatch").alias("reason"))
    return good, bad


def class_token_probs(tokens: DataFrame, key_cols: list[str]) -> DataFrame:
    """D3 + D4: locate class tokens in a token trace and derive probabilities.

    ``tokens`` has ``key…, tokens array<string>, logprobs array<double>,
    top array<map<string,double>>`` (top alternatives' log-probabilities per
    token). A class token is a token equal to '0'/'1' whose ≤7 preceding
    tokens join to end with ``<class>`` and whose next 7 join to start with
    ``</class>``; the n-th such token belongs to the n-th statement.
    """
    w = CLASS_WINDOW
    # Positions of '0'/'1' tokens are found inside the array and only the few tokens around
    # them are looked at; hits alone are exploded, and the explode position is the ordinal.
    places = F.filter(F.transform("tokens", lambda t, i: F.when(t.isin("0", "1"), i)), lambda i: i.isNotNull())

    def around(toks: Column, i: Column) -> Column:
        start = F.greatest(i - w, F.lit(0))
        before = F.array_join(F.slice(toks, start + 1, i - start), "")
        after = F.array_join(F.slice(toks, i + 2, F.lit(w)), "")
        return F.lower(before).endswith("<class>") & F.lower(after).startswith("</class>")

    at = tokens.select(*key_cols, "tokens", "logprobs", "top", F.filter(places, lambda i: around(F.col("tokens"), i)).alias("_at"))
    found = F.transform("_at", lambda i: F.struct(
        i.alias("pos"), F.get("tokens", i).alias("token"), F.get("logprobs", i).alias("logprob_raw"), F.get("top", i).alias("_top")))
    hits = at.select(*key_cols, F.posexplode(found).alias("statement_idx", "h")).select(*key_cols, "statement_idx", "h.*")
    return two_way_probs(hits, "_top", "logprob_raw").drop("_top")


def _isclose_one(c: Column) -> Column:
    return F.abs(c - 1.0) <= 1e-8 + 1e-5


def two_way_probs(df: DataFrame, top_col: str, lp_col: str) -> DataFrame:
    """p0/p1 from top log-probabilities; missing side → 0 if the other ≈ 1 else −1;
    prob_norm = exp(lp) / (p0 + p1) when both are known, else exp(lp)."""
    p0r = F.coalesce(F.exp(F.col(top_col).getItem("0")), F.lit(-1.0))
    p1r = F.coalesce(F.exp(F.col(top_col).getItem("1")), F.lit(-1.0))
    d = df.withColumn("_p0r", p0r).withColumn("_p1r", p1r)
    p0 = F.when(_isclose_one(F.col("_p1r")) & (F.col("_p0r") == -1), F.lit(0.0)).otherwise(F.col("_p0r"))
    p1 = F.when(_isclose_one(F.col("_p0r")) & (F.col("_p1r") == -1), F.lit(0.0)).otherwise(F.col("_p1r"))
    d = d.withColumn("p0", p0).withColumn("p1", p1)
    total = F.when((F.col("p0") != -1) & (F.col("p1") != -1), F.col("p0") + F.col("p1")).otherwise(F.lit(1.0))
    return d.withColumn("prob_norm", F.exp(F.col(lp_col)) / total).drop("_p0r", "_p1r")


def parse_label_list(text: Column) -> Column:
    """Numbered 'n. True/False' list → array<boolean>."""
    return F.transform(F.regexp_extract_all(text, F.lit(LABEL_LIST_PATTERN), 1), lambda x: F.lower(x) == "true")


def response_body(text: Column, tag: str = "response") -> Column:
    """struct(body, left_trim, right_trim) of the text between the tags."""
    inner = TX.between_tags(text, tag)
    lstripped = F.regexp_replace(inner, "^\\s+", "")
    body = F.regexp_replace(lstripped, "\\s+$", "")
    return F.struct(body.alias("body"),
                    F.substring(inner, 1, F.length(inner) - F.length(lstripped)).alias("left_trim"),
                    F.substring(lstripped, F.length(body) + 1, F.length(lstripped)).alias("right_trim"))


def slice_body_logprobs(logprobs: Column, prefix_len: Column, body_len: Column) -> Column:
    """Logprobs of the body tokens: positions prefix_len .. prefix_len+body_len-1 (1-based)."""
    return F.slice(logprobs, prefix_len, body_len)


def top_logprob_rounded(top: Column) -> Column:
    """The highest alternative per token, rounded to 8 digits."""
    return F.transform(top, lambda m: F.round(F.array_max(F.map_values(m)), 8))


def parse_claim_list(text: Column, tag: str = "new_claims") -> Column:
    """Lines between the tags, spaces stripped, leading '-' removed."""
    inner = TX.strip(TX.between_tags(text, tag))
    return F.transform(F.split(inner, "\n"), lambda s: F.regexp_replace(F.trim(s), "^-+", ""))


# ---------------------------------------------------------------- truncation

def truncate(stmts: DataFrame, key_cols: list[str], budget_words: Column | int,
             estimate=None) -> DataFrame:
    """Keep statement k while the token budget left *before* it is > 0.

    Budget = words × 4/3 tokens; a statement's cost is ``estimate(text)``
    (default words × 4/3). Returns the kept statements with ``n_before``.
    """
    est = (estimate or TX.token_estimate)(F.col("text"))
    budget = (budget_words if isinstance(budget_words, Column) else F.lit(budget_words)) * F.lit(TX.WORDS_TO_TOKENS)
    w = Window.partitionBy(*key_cols).orderBy("statement_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = stmts.withColumn("_cost", est).withColumn("_spent", F.coalesce(F.sum("_cost").over(w), F.lit(0.0)))
    return s.filter(budget - F.col("_spent") > 0).drop("_cost", "_spent")


def truncate_words(stmts: DataFrame, key_cols: list[str], budget_col: str) -> DataFrame:
    """D12 for the default estimator in exact integer form: Σ words before < budget words."""
    return words_before(stmts, key_cols).filter(F.col("_words_before") < F.col(budget_col)).drop("_words_before")


def words_before(stmts: DataFrame, key_cols: list[str]) -> DataFrame:
    """``_words_before``: the words of a response's statements before each statement."""
    w = Window.partitionBy(*key_cols).orderBy("statement_idx").rowsBetween(Window.unboundedPreceding, -1)
    return stmts.withColumn("_words_before", F.coalesce(F.sum(TX.word_count(F.col("text"))).over(w), F.lit(0)))


def rebuild_text(kept: DataFrame, key_cols: list[str], all_keys: DataFrame | None = None) -> DataFrame:
    """Join kept statements with spaces; add '.' unless it ends with '.' or '!'.

    ``all_keys`` (optional) lists every response so that one with nothing kept
    still yields '.' as in the original.
    """
    g = kept.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("statement_idx", "text"))),
                                 lambda s: s["text"]), " ").alias("_joined"),
        F.count(F.lit(1)).alias("n_kept"))
    if all_keys is not None:
        g = all_keys.select(*key_cols).distinct().join(g, key_cols, "left").fillna({"n_kept": 0, "_joined": ""})
    ends = F.col("_joined").endswith(".") | F.col("_joined").endswith("!")
    return g.withColumn("truncated", F.when(ends, F.col("_joined")).otherwise(F.concat("_joined", F.lit(".")))).drop("_joined")


def chunk_ids(stmts: DataFrame, size: int) -> DataFrame:
    """Fixed-size chunk id of each statement (batching only)."""
    return stmts.withColumn("chunk_idx", F.floor(F.col("statement_idx") / size).cast("int"))
