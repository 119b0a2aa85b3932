"""The pipeline stage by stage: each stage's rows against brute force on its own input, nulls and empty tables."""

import re
from collections import Counter

import pytest
from consonance.llm import quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from conftest_llm import DOC, EDGE_ROWS, prose, words_of

SF = "/root/testdata/sf0.001"


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small table's documents, rows of every edge case, near copies, a benchmark passage and personal data."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    t = prose(70, 200)
    planted = [(5001, t, "en", "p", 1), (5002, t + " with an end", "en", "p", 1), (5003, "A start and " + t, "en", "p", 1), (5004, prose(71, 90) + " " + item, "en", "p", 1),
               (5005, prose(72, 90) + " a.b@c.org and 10.1.2.3.", "en", "p", 1), (None, prose(73, 80), "en", "p", 1), (None, prose(73, 80) + " more", "en", "p", 1)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(EDGE_ROWS + planted, DOC))
    return tables(spark, tmp_path_factory.mktemp("pipeline") / "t", rows)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def stage_input(spark, corpus, n):
    """What the first ``n`` stages leave, each read from Parquet as the pipeline does."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in P.STAGES[:n]:
        path = f"{corpus}/after-{name}"
        try:
            docs = spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - not written yet
            stage(spark, docs, corpus).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


def test_stages_and_their_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_quality_keeps_what_the_classifier_accepts(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = stage_input(spark, corpus, 1)
    assert out.columns == docs.columns
    scores = {}
    for r in quality.score(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect():
        scores.setdefault(r.key.doc_id, []).append(r.score)
    kept = rows_of(out)
    assert not kept - rows_of(docs) and 0 < sum(kept.values()) < docs.count()
    want = Counter({d: sum(s >= 0.3 for s in x) for d, x in scores.items()})
    assert Counter(k[0] for k in kept.elements()) == +want


def test_one_of_each_group_of_near_copies_stays(spark, corpus):
    docs, out = stage_input(spark, corpus, 1), stage_input(spark, corpus, 2)
    rows, kept = [tuple(r) for r in docs.collect()], rows_of(out)
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or not sets[i] and not sets[j] and rows[i][1] == rows[j][1] and (rows[i][1] or rows[i][0] == rows[j][0]):
                group = [group[i] if g == group[j] else g for g in group]
    assert not kept - rows_of(docs) and sum(kept.values()) == len({g for i, g in enumerate(group)} - {g for i, g in enumerate(group) if not rows[i][1]}) + len(
        {r[0] for r in rows if not r[1]})
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best.setdefault(group[i], []).append((r[0] is None, r[0] or 0))
    assert Counter((r[0] is None, r[0] or 0) for r in kept.elements() if words_of(r[1])) == Counter(min(x) for x in best.values())


def test_contaminated_documents_go(spark, corpus):
    docs, out = stage_input(spark, corpus, 2), stage_input(spark, corpus, 3)
    grams = set()
    for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect():
        w = words_of(r.text)
        n = min(13, len(w))
        grams |= {tuple(w[i: i + n]) for i in range(len(w) - n + 1) if n}
    lengths = {len(g) for g in grams}
    want = Counter()
    for r in docs.collect():
        w, hit = words_of(r.text), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) in grams:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want[tuple(r)] += 1
    assert rows_of(out) == want and out.columns == docs.columns


def test_personal_data_is_replaced(spark, corpus):
    docs, out = stage_input(spark, corpus, 3), stage_input(spark, corpus, 4)
    assert out.schema == docs.schema and out.count() == docs.count()
    pii = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|(?<![0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}(?![0-9.])"
    before = {(r.doc_id, r.lang, r.source): r for r in docs.collect() if r.doc_id is not None}
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        old = before.get((r.doc_id, r.lang, r.source))
        if old is not None and old.text is not None:
            if not re.search(r"@|[0-9]", old.text):
                assert r.text == old.text
            # what is left of the old text stands in its order around the marks
            at = 0
            for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text):
                at = old.text.find(piece, at)
                assert at >= 0
                at += len(piece)
            assert not re.search(pii, r.text) or any(int(x) > 255 for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", r.text) for x in m.group().split("."))
    texts = {r.doc_id: r.text for r in out.collect()}
    if 5005 in texts:
        assert texts[5005] == prose(72, 90) + " [EMAIL] and [IP]."


def test_every_id_is_packed_once(spark, corpus):
    docs = stage_input(spark, corpus, 4)
    tok = Tokenizer.from_file(P.queries.tokenizer_path())
    want = Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    rows = P.STAGES[4][1](spark, docs, corpus).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_run_gives_the_last_stage(spark, corpus):
    got = P.run(spark, corpus)
    want = P.STAGES[4][1](spark, stage_input(spark, corpus, 4), corpus)
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert got.columns == want.columns and tuple(total(got)) == tuple(total(want))


def test_an_empty_table(spark, tmp_path):
    path = tables(spark, tmp_path / "e", spark.createDataFrame([], DOC))
    assert P.run(spark, path).count() == 0
