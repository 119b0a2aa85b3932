"""Personal data: what trees and thresholds are fitted on, added spans against brute force, texts of very many matches."""

import re as plain_re
import time

import pytest
import regex as re
from consonance.llm import pii
from pyspark.sql import functions as F


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cards = [(10_000 + i, f"paid with {4000001234567000 + i} and more") for i in range(400)]
    mails = [(20_000 + i, f"write to é{i}@x.org or to b{i}@x.org") for i in range(200)]
    phones = [(30_000 + i, f"{w} {n}-010-{2000 + i}.") for i in range(120) for w, n in ((("tel", "555"), ("order", "0-555"), ("or", "555"), ("fax:", "(555) 444"))[i % 4],)]
    return docs.unionByName(spark.createDataFrame(cards + mails + phones, "doc_id long, text string"))


def luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def brute_candidates(text):
    """(start, end, kind, label, features) of each loose match."""
    out = []
    for k, kind in enumerate(pii.KINDS):
        test, pattern = pii.LOOSE[kind]
        if not re.search(test, text):
            continue
        last = 0
        for x in re.finditer(pattern, text):
            gap, m = text[last: x.start()], x.group()
            last = x.end()
            before = gap[-pii.CONTEXT:].lower()
            digits, bare = re.sub("[^0-9]", "", m), m.removeprefix("+")
            runs = re.findall("[0-9]+", bare)
            against = re.search(pii.AGAINST + r"\W*\Z", before) is not None
            if kind == "email":
                label = float(bool(re.search(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2}\Z", m)) and not against)
            elif kind != "phone":
                label = float(valid(kind, m) and not against)
            else:
                spoken = m[0] == "+" or re.search(pii.FOR_PHONE + r"\W*\w{0,4}\W*\Z", before)
                label = 0.0 if against or not valid(kind, m) else 1.0 if spoken else None
            place = 3.0 if re.search(r"[0-9]\W?\Z", before) else 2.0 if re.search(r"[a-z]\Z", before) else 1.0 if re.search(r"=\W*\Z", before) else 0.0
            f = dict(zip(pii.FEATURES, (float(k), len(digits), len(bare), m.count(" "), m.count("."), m.count("-"), m.count("(") + m.count(")"), len(runs),
                                        max(map(len, runs), default=0), float(2 <= len(digits) <= 40 and luhn(digits)),
                                        float(bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", bare)) and valid("ip", bare)), place)))
            out.append((x.start(), x.end(), k, label, f))
    return out


def margin_of(sql):
    """The margin's SQL as a function of the features."""
    body = plain_re.sub(r"([0-9.]+(?:[eE][+-]?[0-9]+)?)D", r"\1", sql).replace("CASE WHEN ", "_if(").replace(" THEN ", ", ").replace(" ELSE ", ", ").replace(" END", ")")
    code = compile(plain_re.sub(r"c\.(\w+)", r"f['\1']", body), "margin", "eval")
    return lambda f: eval(code, {"_if": lambda x, a, b: a if x else b, "f": f})  # noqa: S307


TEXTS = ["tel 555-010-2030", "é1@x.org and é2@x", "order 555-010-2030, isbn 1234567890123", "cards 4465758382889437 4465758382889437", "10.0.0.1 300.1.2.3 v 1.2.3.4",
         "fax: (555) 444-1234, x=555 010 2030", "", "a@b.cd,e@f.gh;i@j.kl", "+1 (555) 010-2030 +44 20 7946 0958", "4465-7583-8288-9437 phone 12 555.010.2030"]


def test_candidates_labels_and_added_spans_are_brute_force(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    found = pii.matched(docs)
    margin, thresholds = pii.fit(found)
    score = margin_of(margin)
    bins = {}
    rows = pii.find(found, (margin, thresholds)).join(found.select(F.col("doc").alias("d"), "loose"), F.col("doc") == F.col("d")).collect()
    added = 0
    for r in rows:
        cands = brute_candidates(r.doc.text or "")
        got = [(c.start, c.end, c.kind, c.label, {n: c[n] for n in pii.FEATURES}) for c in r.loose]
        assert got == cands, r.doc.text
        base = {tuple(s) for s in r.base}
        extra = {(a, k, z) for a, z, k, _, f in cands if k in thresholds and score(f) >= thresholds[k] and not any(s <= a and e >= z for s, _, e in base)}
        assert {tuple(s) for s in r.spans} == base | extra
        added += len(extra)
        for _, _, k, label, f in cands:
            if label is not None:
                bins.setdefault(k, []).append((round(score(f) + 0.0, 2), label))
    assert added > 100
    for k, marked in bins.items():
        fits = [m for m in {m for m, _ in marked} if sum(x for n, x in marked if n >= m) >= 0.98 * sum(n >= m for n, _ in marked)]
        assert (thresholds.get(k) is None and not fits) or thresholds[k] == pytest.approx(min(fits) - 0.005, abs=0.011)
    text = {r.doc.doc_id: {(s.start, s.kind, s.end) for s in r.spans} for r in rows}
    assert (4, 3, 16) in text[90_000]             # a number without a plus
    assert (0, 0, 8) in text[90_001]              # an address whose local part is not ASCII
    assert {(6, 2, 22), (23, 2, 39)} <= text[90_003]


def test_the_label_is_no_function_of_the_features(spark):
    seen = {}
    for r in pii._columns(corpus(spark)).select(F.explode("loose").alias("c")).collect():
        seen.setdefault(tuple(r.c[n] for n in pii.FEATURES), set()).add(r.c.label)
    assert any(len(x) > 1 for x in seen.values())


def test_copies_of_a_text_are_fitted_on_once(spark, monkeypatch):
    sizes, stored = [], pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, name: (name == "pii-candidates" and sizes.append(df.count())) or stored(df, name))
    docs = corpus(spark)
    once = pii.fit(pii.matched(docs))
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("cards 4465758382889437 4465758382889437 twice").alias("text"))
    assert once is not None and pii.fit(pii.matched(docs.unionByName(copies))) is not None
    assert sizes[1] == sizes[0] + 2


def test_trees_are_fitted_on_texts_that_hold_candidates(spark):
    plain = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("no data, text "), F.col("id")).alias("text"))
    assert pii.fit(pii.matched(corpus(spark).unionByName(plain)), train_docs=300) is not None


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org"), (2, None)], "doc_id long, text string")
    found = pii.matched(docs)
    assert pii.fit(found) is None and pii.fit(pii.matched(docs.limit(0))) is None
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [EMAIL]", None]


def test_very_many_matches_in_one_text(spark):
    """Time grows in proportion to the matches of a text; spans at the edges of blocks are whole."""
    def run(n):
        parts = [f"user{i}@host{i % 7}.example.org, é +1 555 010 {i % 10000:04d};" for i in range(n)]
        text = " ".join(parts)
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        found = pii.matched(docs)
        r = pii.find(found, None).select("doc", "spans", pii.redacted(F.col("doc.text"), F.col("spans")).alias("out")).first()
        took = time.time() - t
        assert len(r.spans) == 2 * n
        assert r.out == " ".join("[EMAIL], é [PHONE];" for _ in range(n))
        assert all(text[s.start:s.end] == (f"user{i // 2}@host{i // 2 % 7}.example.org" if s.kind == 0 else f"+1 555 010 {i // 2 % 10000:04d}") for i, s in enumerate(r.spans))
        return took

    run(100)
    small, large = run(4_000), run(16_000)
    assert large < 8 * max(small, 1.0)
