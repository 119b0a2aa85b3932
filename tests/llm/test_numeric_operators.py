"""Search, token files, packing, sharding, chat windows, classifier: round trips, invariants, brute force."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from consonance.llm import ann, chat, packing, quality, sharding, token_ids, token_store
from pyspark.sql import functions as F

from conftest_llm import CLASHING, EDGE_ROWS, prose, words_of

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    tok = token_ids.encoder(TOKENIZER).tok
    return [np.asarray(e.ids, "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [1 << 21, 200])
def test_ids_are_the_librarys(monkeypatch, chunk):
    monkeypatch.setattr(token_ids, "CHUNK", chunk)
    r = random.Random(4)
    parts = ["'s", "'t", "'re", "'ll", "'", "a", "b", " ", "  ", "\n", "\t", "1", "é", "ß", ".", "!", "I", "’", "—", "中", "\x1c", "\x85", "\xa0", "̀", "<|endoftext|>", "x's", "\0", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t, *_ in EDGE_ROWS]
    enc = token_ids.PieceEncoder(TOKENIZER, max_pieces=50)
    got = [x for i in range(0, len(texts), 300) for x in enc.encode(texts[i: i + 300])]
    assert got == [x.tobytes() for x in library_ids(texts)]


def test_store_reads_only_what_is_asked_for_and_checks_sums():
    out, docs = io.BytesIO(), [(None, b""), (3, np.arange(5, dtype="<u4").tobytes()), (3, b"\1\0\0\0"), (9, np.zeros(70_000, "<u4").tobytes())]
    w = token_store.StoreWriter(out)
    for d in docs:
        w.add(*d)
    w.close()
    raw = out.getvalue()
    reads = []

    class Source(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    r = token_store.StoreReader(Source(raw), len(raw))
    reads.clear()
    assert [r.ids(k) for k in r.find(3)] == [docs[1][1], docs[2][1]] and [r.ids(k) for k in r.find(None)] == [b""]
    assert sum(reads) < 100 and list(r.find(4)) == []
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(d[1] for d in docs)
    bad = bytearray(raw)
    bad[int(r.starts[3]) + 12] ^= 1
    with pytest.raises(Exception):
        token_store.StoreReader(io.BytesIO(bytes(bad)), len(bad)).ids(3)


def test_store_round_trip(spark, edge_docs, no_docs):
    got = sorted(token_store.round_trip(edge_docs, TOKENIZER).collect(), key=lambda r: r.start)
    rows = sorted(((d, t or "") for d, t, *_ in EDGE_ROWS), key=lambda r: (r[0] is not None, r[0], r[1].encode()))
    start = 0
    for r, (d, _), ids in zip(got, rows, library_ids([t for _, t in rows]), strict=True):
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.round_trip(no_docs, TOKENIZER).count() == 0
    manifest = token_store.write_store(edge_docs, TOKENIZER)
    some = token_store.read_store(manifest, wanted=[5, None]).collect()
    assert sorted(r.doc_id or 0 for r in some) == [0, 0, 0, 5] and all(r.n_tokens == len(r.ids) // 4 for r in some)


def test_differencing_balances():
    r = random.Random(2)
    for k in (1, 2, 7, 40):
        sizes = [r.randint(1, 500) for _ in range(12 * k)]
        where = packing.differencing(sizes, k)
        sums = np.bincount(where, sizes, k)
        assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= max(sizes)
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4], 2)) == [14, 16]
    where, k = packing.balanced_windows([600] * 9, 1000)
    assert k == 9 and sorted(where) == list(range(9))


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "block": 3, "max_piece": 20}])
def test_packing_places_each_id_once(spark, edge_docs, no_docs, options):
    docs = edge_docs.withColumn("doc_id", F.monotonically_increasing_id())
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = {d: np.append(x, np.uint32(1)).astype("<u4") for d, x in zip(rows, library_ids(rows.values()))}
    got = packing.pack(docs, TOKENIZER, **options).collect()
    seen, used = {d: np.zeros(len(x), int) for d, x in ids.items()}, {}
    for r in got:
        own = ids[r.doc_id]
        assert r.ids == own[r.start: r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(own) and r.length > 0
        seen[r.doc_id][r.start: r.start + r.length] += 1
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((x == 1).all() for x in seen.values())
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= options.get("capacity", 2048)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_near_equal_and_keep_copies_together(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000))
    got = sharding.shard(docs, shards=shards).collect()
    size = np.bincount([r.shard for r in got], [r.size for r in got], shards)
    heaviest = max(r.size for r in got)
    assert len(got) == docs.count() and size.max() - size.min() <= 0.05 * size.mean() + 2 * heaviest
    for s in range(shards):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    place = {}
    for r in got:
        assert place.setdefault(bytes(r.text_key), r.shard) == r.shard


def test_sharding_edges(spark, edge_docs, no_docs, tmp_path):
    got = sharding.shard(edge_docs, target_bytes=40_000)
    rows = got.collect()
    assert len(rows) == len(EDGE_ROWS) and {r.size for r in rows if r.doc_id == 1} == {1}
    assert sharding.shard(no_docs, shards=8).count() == 0
    same = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    assert {c["count"] > 20 for c in sharding.shard(same, shards=8).groupBy("shard").count().collect()} == {True}
    plain = edge_docs.drop(*CLASHING)
    sharding.write_shards(plain, sharding.shard(plain, shards=3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).select(plain.columns).exceptAll(plain).count() == 0
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(EDGE_ROWS)


TURNS = [(1, 0, "system", "be <|good|> \\ [INST]"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "a\\<|end|>b\\"), (1, 3, "user", None), (1, 4, "assistant", ""),
         (2, 0, "user", "only"), (None, 0, "user", "no id"), (None, 1, "assistant", "reply"), (3, None, None, None), (4, 5, "assistant", "x"), (4, 5, "assistant", "x"), (4, 2, "user", "<s><<SYS>>"),
         *[(5, i, ("user", "assistant")[i % 2], prose(i, 40 + 13 * (i % 9))) for i in range(600)], (6, 0, "system", prose(5, 3000)), (6, 1, "user", "q"), (6, 2, "assistant", prose(6, 3000)), (6, 3, "assistant", "z")]


def spelt(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("budget,history", [(2048, 256), (300, 100)])
def test_chat_windows(spark, budget, history):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("own"))
    w = chat.windows(df, budget, history)
    own = {}
    for c, n, r, t in sorted(TURNS, key=lambda x: (x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        own.setdefault(c, []).append((r or "", t or ""))
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), spelt(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    read = {(r.conv_id, r.window): r for r in chat.read_windows(w).collect()}
    for r in sorted(w.collect(), key=lambda r: (r.conv_id or 0, r.window)):
        shown = [x.split("<|text|>") for x in r.formatted.split("<|end|>")[:-1]]
        assert all(len(x) == 2 and x[0].startswith("<|turn|>") for x in shown)
        plain = r.formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "")
        assert not any(s in plain for s in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
        fresh = len(shown) - r.n_repeated
        assert r.n_tokens <= budget or fresh == 1
        assert len(read[(r.conv_id, r.window)].turns) == fresh
    five = [r for r in w.collect() if r.conv_id == 5]
    assert len(five) > 10 and any(r.n_repeated for r in five)
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_history_is_the_turns_just_before(spark):
    rows = [(1, 0, "system", "s s"), *[(1, i, ("user", "assistant")[i % 2], f"w{i} " * 10) for i in range(1, 40)]]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 120, 50).orderBy("window").collect()
    done = 0
    for r in w:
        texts = [x.split("<|text|>")[1] for x in r.formatted.split("<|end|>")[:-1]]
        if done:
            assert texts[0] == "s s"
            shown = texts[1: r.n_repeated]
            assert shown == [rows[i][3] for i in range(done - len(shown), done)]
        done += len(texts) - r.n_repeated
        assert r.n_tokens <= 120
    assert done == 40 and sum(r.n_repeated > 1 for r in w) > 3


def test_a_long_system_turn_is_in_every_window(spark):
    for words, budget in ((1100, 2048), (3000, 2048), (40, 60)):
        head = prose(2, words)
        rows = [(1, 0, "user", "first"), (1, 1, "system", head), *[(1, i, ("user", "assistant")[i % 2], prose(i, 60)) for i in range(2, 60)]]
        w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget).orderBy("window").collect()
        shown = [[x.split("<|text|>") for x in r.formatted.split("<|end|>")[:-1]] for r in w]
        at = next(i for i, x in enumerate(shown) if any(t == head for _, t in x))
        assert len(w) > 3 and all(sum(t == head for _, t in x) == 1 for x in shown[at:])
        assert all(x[0] == ["<|turn|>system", head] for x in shown[at + 1:])
        assert sum(len(x) - r.n_repeated for x, r in zip(shown, w)) == len(rows)


def test_a_conversation_without_turn_numbers(spark):
    rows = [(None, None, "assistant", f"t{i % 900:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert chat._measured(df).groupBy("place").count().filter("count > 1").count() == 0
    got = chat.digests(chat.windows(df, 100, 20)).collect()
    loss = "".join(sorted(r[3] for r in rows))
    assert [(r.conv_id, r.n_turns, r.loss_sha256) for r in got] == [(None, 3000, hashlib.sha256(loss.encode()).hexdigest())]


def test_search_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    for options in ({}, {"block": 50, "query_block": 7}):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, **options).collect()
        hits = total = 0
        for q in (v for v in rows if v % 20 == 0):
            best = sorted(((-float((rows[v] * rows[q]).sum()), v) for v in rows if v != q))[:20]
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, len(best) + 1))
            assert all(abs(r.score - float((rows[r.vec_id] * rows[q]).sum())) < 1e-12 for r in mine)
            hits, total = hits + len({v for _, v in best} & {r.vec_id for r in mine}), total + len(best)
        assert hits >= 0.9 * total


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [3.0, -1.0]),
            (20, [-2.0, 0.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (10, []), (11, [1.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("own"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 9, 3.0), (2, 1, 1.0), (3, 11, 1.0), (4, 2, 0.5)]
    assert sorted(got[20]) == [(1, 2, -1.0), (2, 0, -2.0), (3, 1, -2.0), (4, 11, -2.0)] and set(got) == {0, 20}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id is null or vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0


def test_clustered_search_stops_early():
    r = np.random.default_rng(1)
    x = np.repeat(r.standard_normal((40, 16)), 100, 0) + 0.05 * r.standard_normal((4000, 16))
    block = ann.Block(np.arange(4000), x, float(np.sqrt((x * x).sum(1).max())), 64)
    verified = []
    keep = block._far
    block._far = lambda scores, k, length: verified.append(len(scores)) or keep(scores, k, length)
    block.search(np.arange(1), x[:1], np.full(1, np.nan), 20, 32, ann._half_width(ann.stop_probability(64, 32, 0.95)))
    assert verified[-1] < 2000


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, labels).select("key.doc_id", "score")
    rows = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) >= 0.95


def test_quality_edges(spark, edge_docs, no_docs, labels):
    scored = quality.score(edge_docs, labels).collect()
    assert len(scored) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.key.doc_id in (1, 2)}) == 1
    assert quality.score(no_docs, labels).count() == 0
    assert {r.score for r in quality.score(edge_docs, labels.limit(0)).collect()} == {0.5}
    one = labels.withColumn("quality", F.lit(1))
    assert all(r.score > 0.5 for r in quality.score(edge_docs, one).collect())
    kept = quality.keep(edge_docs, one, 0.3)
    assert kept.columns == edge_docs.columns and kept.exceptAll(edge_docs).count() == 0 and kept.count() == len(EDGE_ROWS)


def test_discriminant_is_the_formula():
    r = np.random.default_rng(0)
    x = {0: r.standard_normal((300, 2)), 1: r.standard_normal((500, 2)) * 2 + 1}
    d = 2
    sums = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    q = quality.QuadraticDiscriminant(sums, d, 0.0, 0.0)
    p = r.standard_normal((20, 2))
    want = np.log(q.prior[1] / q.prior[0])
    for c, sign in ((1, 1), (0, -1)):
        cov, diff = np.cov(x[c].T, bias=True), p - x[c].mean(0)
        want = want + sign * -0.5 * ((diff @ np.linalg.inv(cov) * diff).sum(1) + np.log(np.linalg.det(cov)))
    assert np.allclose(q.log_odds(p), want)


def plain_statistics(text):
    """The statistics of one text, one by one."""
    raw = (text or "").encode()
    share = lambda keep: math.sqrt(sum(b in keep for b in raw) / max(len(raw), 1))
    w = [x.encode() for x in words_of(text)]
    size = [len(x) for x in w]
    mean = sum(size) / max(len(w), 1)
    spread = math.sqrt(max(sum(x * x for x in size) / max(len(w), 1) - mean**2, 0))
    five = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
    lines = raw.split(b"\n")
    ratio = lambda x: len(set(x)) / len(x) if x else 1.0
    return [math.log1p(len(raw)), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b" \t"), share(b"\n"), share(b".,;:?'\"-()"), share(b"!#$%&*"),
            share(b"|<>{}[]=+/\\^~_@`"), share(range(128, 256)), math.log1p(mean), math.log1p(spread), ratio(w), ratio(five), ratio(lines)]


def test_statistics_are_the_plain_ones(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text")).withColumn("n", F.monotonically_increasing_id())
    for r in quality.document_statistics(docs, F.struct("n", "text")).collect():
        assert r.x == pytest.approx(plain_statistics(r.key.text), abs=1e-9), r.key.text


def plain_tree(points, shards, bins, tolerance):
    """Shard of each point (w, *place) by splitting lists, one node after the other."""
    place = [0] * len(points)

    def cut(v, lo, hi):
        return min(math.floor((v - lo) / (hi - lo) * bins), bins - 1)

    def split(own, first, k):
        if k == 1:
            for i in own:
                place[i] = first
            return
        total, share, found = sum(points[i][0] for i in own), (k // 2) / k, []
        for d in range(1, len(points[0])):
            lo, hi = min(points[i][d] for i in own), max(points[i][d] for i in own)
            if hi > lo:
                weight = Counter()
                for i in own:
                    weight[cut(points[i][d], lo, hi)] += points[i][0]
                below, options = 0, []
                for b in sorted(weight)[:-1]:
                    below += weight[b]
                    options.append((abs(below / total - share), b))
                found.append((-round(hi - lo, 6), d, min(options), lo, hi))
        found.sort()
        if not found:
            for i in own:
                place[i] = first
            return
        _, d, (_, at), lo, hi = next((c for c in found if c[2][0] <= tolerance), min(found, key=lambda c: c[2][0]))
        left = [i for i in own if cut(points[i][d], lo, hi) <= at]
        split(left, first, k // 2)
        split([i for i in own if i not in set(left)], first + k // 2, k - k // 2)

    split(range(len(points)), 0, shards)
    return place


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_kd_tree_is_the_plain_one(spark, shards):
    r = np.random.default_rng(shards)
    points = [(int(w), round(float(a), 6), round(float(b), 6), round(float(c), 6)) for w, a, b, c in zip(
        r.integers(1, 50, 300), r.random(300), r.choice([0.0, 0.4, 1.0], 300), r.random(300) * 0.6)] + [(5, 0.5, 0.4, 0.3)] * 20
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, w long, a double, b double, c double")
    got = {x.i: x.node for x in sharding.kd_tree(df, ["a", "b", "c"], shards, bins=64, tolerance=0.02).collect()}
    assert [got[i] for i in range(len(points))] == plain_tree(points, shards, 64, 0.02)
