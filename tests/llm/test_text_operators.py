"""Words, near duplicates, decontamination, licences, personal data: against brute force on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from consonance.llm import common, components, decontaminate, licences, near_dup, pii

from conftest_llm import EDGE_ROWS, prose, words_of

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_and_hashes_match_the_pattern(monkeypatch):
    texts = [r[1] for r in EDGE_ROWS] + ["Ä b ABC1é!x", "a", "é" * 3000]
    for block in (1 << 20, 64):
        monkeypatch.setattr(common, "BLOCK", block)
        off, data = common.text_bytes(pa.array(texts))
        st, en, h, first = common.words(off, data)
        seen = {}
        for i, t in enumerate(texts):
            got = [bytes(common.WORD_BYTES[data[a:b]]).decode() for a, b in zip(st[first[i]:first[i + 1]], en[first[i]:first[i + 1]])]
            assert got == words_of(t)
            for w, x in zip(got, h[first[i]:first[i + 1]].tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def brute_join(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, n = list(range(len(rows))), Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root[i]] = min(doc_id, ids.get(root[i], doc_id))
    return Counter((d, hashlib.md5((t or "").encode()).digest(), ids.get(root[i]) if sets[i] else d, n[i]) for i, (d, t) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_join_is_brute_force(spark, block):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    got = near_dup.join(documents(spark), block=block).collect()
    assert Counter((r.doc_id, bytes(r.text_key), r.class_id, r.n_links) for r in got) == brute_join(rows)


def test_jaccard_join_edges(edge_docs, no_docs):
    rows = [r[:2] for r in EDGE_ROWS]
    got = near_dup.join(edge_docs).collect()
    assert Counter((r.doc_id, bytes(r.text_key), r.class_id, r.n_links) for r in got) == brute_join(rows)
    assert near_dup.join(no_docs).count() == 0
    kept = near_dup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 13]
    assert near_dup.keep_one(no_docs).count() == 0


def test_one_row_of_a_group_stays_with_or_without_ids(spark):
    t = prose(3, 80)
    near = [t, t + " and one", "one more " + t]
    rows = [*[(None, x) for x in near], *[(i, prose(4, 60) + tail) for i, tail in ((7, ""), (7, " x"), (8, " y"))], (20, "***"), (21, "***"), (None, "***"), (22, "* *"), (23, ""), (24, ""), (25, None), (None, ""), (None, None)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 7, 20, 22, 23, 24, 25]
    assert sum(r.text in near for r in kept) == 1 and [r.doc_id for r in kept if r.text == "***"] == [20]


def test_prefix_is_shortened_until_the_recall_is_reached():
    for s, trees, recall in ((0.8, 32, 0.999), (0.5, 16, 0.9), (0.95, 4, 0.99)):
        d = near_dup.prefix_depth(s, trees, recall, 16)
        assert 1 - (1 - s**d) ** trees >= recall or d == 1
        assert d == 16 or 1 - (1 - s ** (d + 1)) ** trees < recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(500, x) for x in range(501, 560)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100, **{x: 500 for x in range(500, 560)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_hits(text, items, window=13):
    w, marked, names = words_of(text), set(), set()
    for item, item_text in items:
        v = words_of(item_text)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j: j + n] == v[i: i + n]:
                    marked.update(range(j, j + n))
                    if item is not None:
                        names.add(str(item))
    return len(w), len(marked), sorted(names)


@pytest.mark.parametrize("max_slice", [250_000, 7])
def test_decontamination_is_brute_force(edge_docs, benchmark, max_slice):
    items = [tuple(r) for r in benchmark.collect()]
    got = decontaminate.scan(edge_docs, benchmark, max_slice=max_slice).collect()
    assert len(got) == len(EDGE_ROWS)
    for r in got:
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute_hits(r.doc.text, items)
        for a, b, p, q in r.hits.spans:
            assert words_of(r.doc.text[p:q]) == words_of(r.doc.text)[a:b]


def test_decontamination_removes_documents_or_spans(spark, edge_docs, no_docs, benchmark):
    clean = decontaminate.clean(edge_docs, benchmark)
    assert clean.columns == edge_docs.columns
    assert {r.doc_id for r in clean.collect()} == {None, 1, 2, 3, 9, 10, 11, 12, 13}
    cut = {r.doc_id: r.text for r in decontaminate.clean(edge_docs, benchmark, remove="spans").collect()}
    assert cut[4] == "" and cut[7] == prose(1, 60)[len(prose(1, 20).rstrip(".")):] and cut[9] == prose(2, 30_000)
    assert decontaminate.clean(no_docs, benchmark).count() == 0
    assert decontaminate.scan(edge_docs, benchmark.limit(0)).filter("hits.n_hit > 0").count() == 0


def test_licences(spark, no_docs):
    mit = dict(licences.KNOWN)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.lower().replace(", ", " ,\n ")), (3, "text\nReleased under the MIT Licence!\nmore"),
            (4, None), (5, ""), (6, "..."), (7, "Copyright 2021 X"), (3, "text\nReleased under the MIT Licence!\nmore"), (8, "released under the mit licence x"),
            (None, "Licensed  under CC-BY 4.0"), (9, "a\nLicensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0\n" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.licence, r.n_lines, r.line_licences) for r in licences.scan(docs, licences.known_licences(spark), ["doc_id"]).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == ("MIT", 1, ["MIT"]) and by_id[2][0] == "MIT" and by_id[3] == (None, 1, ["MIT-notice"])
    assert by_id[None] == ("CC-BY-4.0-notice", 1, ["CC-BY-4.0-notice"]) and by_id[9] == (None, 4, ["CC-BY-4.0-notice", "CC-BY-SA-4.0-notice"])
    assert all(by_id[k] == (None, 0, []) for k in (4, 5, 6, 7, 8))
    assert licences.scan(no_docs, licences.known_licences(spark), ["doc_id"]).count() == 0


def luhn(d):
    v = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def brute_base(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for k, (pattern, good) in enumerate((
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if good(m)]
    return sorted(out)


TRICKY = ["a@b.c_d@e.f", "x@y.z%foo@bar.com", "a@b..c", "a@b.c.d.", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.255", "1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111",
          "4111  1111 1111 1111", "4111111111111111", "+1 (555) 010-2030", "+1-", "++12345678901", "é +44 20 7946 0958 😀 a@b.co 10.0.0.1", "1 " * 3000, "9" * 30_000, "a." * 5000 + "@" + "b." * 5000 + "c",
          "4465758382889437 4465758382889437", "\x014111 1111\x011111 1111", "12-34 56-78 90 12", "tel 555-010-2030 call", ""]


def test_personal_data_base_spans(spark, edge_docs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text")).unionByName(
        documents(spark).select("doc_id", "text"))
    for r in pii.find(pii.matched(docs), None).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_base(r.doc.text), r.doc.text
        assert r.spans == r.base


def test_personal_data_learns_what_the_patterns_miss(spark, edge_docs, no_docs):
    docs = documents(spark).select("doc_id", "text")
    cards = spark.createDataFrame([(10_000 + i, f"paid with {4000001234567000 + i} and more") for i in range(400)] + [(9_999, "both 4465758382889437 4465758382889437 here")], "doc_id long, text string")
    docs = docs.unionByName(cards)
    found = pii.matched(docs)
    model = pii.fit(found)
    assert model is not None
    rows = {r.doc.doc_id: r for r in pii.find(found, model).collect()}
    for r in rows.values():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert not rows[9_999].base and [s.kind for s in rows[9_999].spans] == [2, 2]
    bad = next(i for i in range(400) if not luhn(str(4000001234567000 + i)))
    assert not rows[10_000 + bad].spans
    out = pii.redact(edge_docs)
    assert out.columns == edge_docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[10] == "mail [EMAIL] or [PHONE], [IP], [CARD]" and text[1] is None and text[9] == prose(2, 30_000)
    assert pii.redact(no_docs).count() == 0


def test_linked_is_exact():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(90) < p], r.integers(0, 1 << 60, k).astype(np.uint64)])) for p in (1, 0.95, 0.9, 0.85) for k in (1, 5, 12)]
    got = near_dup.linked(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9)
