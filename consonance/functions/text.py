"""Column functions for text: tokens, statements, containment, token estimates.

All are built-in Spark expressions (JVM side, codegen); none is a Python UDF.
The default lexical stand-ins (tokens, containment, 3-way NLI) only make the
pipeline runnable offline – they are plumbing checks, not quality claims.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (kept identical in the DuckDB oracles).
TOKEN_SPLIT = "[^a-z0-9]+"
STATEMENT_PATTERN = "[^.\\n]+\\.?"          # a statement ends after '.' or at a newline
WORDS_TO_TOKENS = 4.0 / 3.0                 # token estimate per word


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens (non-ASCII letters act as separators)."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def containment(premise_tokens: Column, hypothesis_tokens: Column) -> Column:
    """|set(p) ∩ set(h)| / |set(p)|, 0 when p has no tokens."""
    p = F.array_distinct(premise_tokens)
    return F.when(F.size(p) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(p, hypothesis_tokens)) / F.size(p))


def statements(text: Column) -> Column:
    """Split after '.' or a newline, trim, drop empty pieces (order kept)."""
    parts = F.regexp_extract_all(text, F.lit(STATEMENT_PATTERN), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_estimate(text: Column) -> Column:
    """D10 default estimator: words × 4/3."""
    return word_count(text) * F.lit(WORDS_TO_TOKENS)


def nli_probs(c: Column) -> Column:
    """Default 3-way NLI stand-in from containment c: (contradiction, neutral, entailment)
    = ((1-c)², 2c(1-c), c²), which sums to 1."""
    return F.struct(((1 - c) * (1 - c)).alias("p_contra"), (2 * c * (1 - c)).alias("p_neutral"),
                    (c * c).alias("p_entail"))


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def strip_tags(text: Column, tags: list[str]) -> Column:
    """Remove tag literals."""
    out = text
    for t in tags:
        out = F.replace(out, F.lit(t), F.lit(""))
    return out


def between_tags(text: Column, tag: str) -> Column:
    """Text between the first <tag> and the following <tag> or </tag> (null when absent)."""
    after = F.element_at(F.split(text, f"<{tag}>", 2), 2)
    return F.when(F.instr(text, f"<{tag}>") > 0, F.element_at(F.split(after, f"</?{tag}>", 2), 1))
