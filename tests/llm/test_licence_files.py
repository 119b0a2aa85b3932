"""Licence scan on licence files as projects ship them: titled, wrapped, with their holders' copyright lines."""

import os

from consonance.llm import licences
from consonance.llm.licences import START, known_licences, one_spelling, scan
from pyspark.sql import functions as F

FILES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_files")


def test_licence_files_are_found(spark):
    files = {name.removesuffix(".txt"): open(os.path.join(FILES, name), encoding="utf-8").read() for name in os.listdir(FILES)}
    assert len(files) == 12
    rows = [(k, t) for k, t in files.items()] + [(f"{k}, cut", t[: len(t) * 9 // 10]) for k, t in files.items()]
    body = files["MIT"][files["MIT"].index("Permission"):]
    rows += [(f"titled {t}", f"{t}\n\nCopyright (c) 2024 A. Holder\n\n{body}") for t in ("MIT License", "MIT Licence", "The MIT License")]
    got = {r.name: r.licence for r in scan(spark.createDataFrame(rows, "name string, text string"), known_licences(spark), ["name"]).collect()}
    assert got == {k: k if k in files else "MIT" if k.startswith("titled") else None for k, _ in rows}


def test_no_spelling_changes_a_forms_start(spark):
    words = ["recognised", "analyse", "labour", "favour", "cancelled", "calibre", "centre", "analogue", "catalogue", "acknowledgement", "sub licence", "sublicence", "licence",
             "offence", "practise", "artefact", "fulfil", "fulfilment", "wilful", "programme", "whilst", "per cent", "non commercial", "copyright owner"]
    assert len(words) >= len(licences.SPELLINGS)
    forms = spark.createDataFrame([(p + w,) for w in words for p in ("", "a ", "an ")], "plain string").select("plain", one_spelling(F.col("plain")).alias("spelt"))
    assert forms.filter("plain <> spelt").count() == forms.count()
    assert forms.filter(F.substring("plain", 1, START) != F.substring("spelt", 1, START)).count() == 0
