"""Licence scan by canonical digests.

A text's canonical form is lower-cased, without copyright lines, with equivalent spellings unified and
every run of characters that are neither letters nor digits turned into one space. Its MD5 digest is
hash-joined to the digests of known licences. Units are whole texts and each of their lines, so a
document that is a licence and a document with a licence line are both found by digests of entire texts.

Null, empty and punctuation-only texts have an empty canonical form and match nothing; so do known
licences of that kind. Known licences with equal canonical forms count under their least id.
Repeated rows get the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import pkgutil
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_key

#: Spellings that licence matching treats as equal, as (pattern on canonical words, what is kept).
SPELLINGS = (
    (r"\b(authori|capitali|categori|emphasi|initiali|maximi|optimi|organi|reali|recogni|utili)s(e|ed|es|ing|ation|ations)\b", "$1z$2"),
    (r"\banalyse", "analyze"),
    (r"\b(lab|fav)our", "$1or"),
    (r"\b(cancel|label|model|signal)l(ed|ing)\b", "$1$2"),
    (r"\b(calib|cent)re\b", "$1er"),
    (r"\b(ana|cata)logue\b", "$1log"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\bsub licen[cs]e", "sublicense"),
    (r"\b(sub|)licence", "$1license"),
    (r"\boffence\b", "offense"),
    (r"\bpractise\b", "practice"),
    (r"\bartefact", "artifact"),
    (r"\bfulfil(ment|)\b", "fulfill$1"),
    (r"\bwilful\b", "willful"),
    (r"\bprogramme\b", "program"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bcopyright owner", "copyright holder"),
)
ANY_SPELLING = "|".join(p for p, _ in SPELLINGS)
SPELLING_RATIO = 1.5
#: Characters at a form's start that no spelling changes (each keeps the first three of what it matches).
START = 3


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the table: each text alone and below each of its titles, with either form of links."""
    out = []
    for row in map(json.loads, pkgutil.get_data(__package__, "known_licences.jsonl").decode().splitlines()):
        links = {row["text"], row["text"].replace("http://", "https://"), row["text"].replace("https://", "http://")}
        out += [(row["licence"], f"{title}\n\n{text}".lstrip()) for title in ("", *row["titles"]) for text in sorted(links)]
    return out


#: Public licence texts, and one-line forms and notices as fixed values.
KNOWN = (
    *full_texts(),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
            "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
            "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "This project is licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0-notice", "Released under CC0 1.0."),
    ("Unlicense-notice", "This is free and unencumbered software released into the public domain."),
)

COPYRIGHT_LINE = r"(?m)^[^\n0-9a-z]*(?:copyright\b[^\n]*(?:[12][0-9]{3}|\(c\)|©)|(?:©|\(c\))[^\n]*[12][0-9]{3}|all rights reserved)[^\n]*$"


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN], "licence string, text string")


def words_only(text: Column) -> Column:
    """Lower case, no copyright lines, single spaces between words."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def one_spelling(t: Column) -> Column:
    out = t
    for pattern, kept in SPELLINGS:
        out = F.regexp_replace(out, pattern, kept)
    return F.when(t.rlike(ANY_SPELLING), out).otherwise(t)


def canonical(units: DataFrame, text: str) -> DataFrame:
    """``units`` with ``plain`` (words only, not empty) in place of ``text``.

    The explode of one element keeps the form from being computed for each use.
    """
    others = [c for c in units.columns if c != text]
    return units.select(*others, F.explode(F.array(words_only(F.col(text)))).alias("plain")).filter(F.col("plain") != "")


def digest() -> Column:
    return F.md5(one_spelling(F.col("plain")).cast("binary"))


def scan(docs: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Per row: ``key`` columns, text_key, licence of the whole text, licences of its lines and their number."""
    prepare(docs.sparkSession)
    # Spellings change a length by less than SPELLING_RATIO either way and no form's start: a text that
    # starts as no known one of about its length cannot match and needs no digest.
    forms = canonical(known.select("licence", "text"), "text")
    table = forms.groupBy(digest().alias("digest")).agg(F.min("licence").alias("licence"))
    start, size = F.substring("plain", 1, START), F.length("plain")
    bounds = forms.groupBy(start.alias("start")).agg(F.min(size).alias("low"), F.max(size).alias("high")).collect()
    fits = reduce(Column.__or__, [(start == r.start) & size.between(r.low / SPELLING_RATIO**2, r.high * SPELLING_RATIO**2) for r in bounds], F.lit(False))
    rows = docs.select(*key, text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    units = rows.select(*key, "text_key", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("line", "unit"))
    # repeated rows share a key: each line counts once
    hits = canonical(units, "unit").filter(fits).withColumn("digest", digest()).join(table, "digest").select(*key, "text_key", "line", "licence").distinct().groupBy(*key, "text_key").agg(
        F.min(F.when(F.col("line") == 0, F.col("licence"))).alias("licence"),
        F.count_if(F.col("line") > 0).alias("n_lines"),
        F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("licence")))).alias("line_licences"))
    return rows.select(*key, "text_key").alias("a").join(
        hits.alias("b"), F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in [*key, "text_key"])), "left").select(
        *[F.col(f"a.`{c}`") for c in [*key, "text_key"]], "licence", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))
