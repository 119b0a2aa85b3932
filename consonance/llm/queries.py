"""Registered queries of the training-data operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, hard_negatives, lexical, licences, near_dup, oph_dedup, packing, pii, quality, sharding, token_store
from .common import read_table

QUALITY_THRESHOLD = 0.3
END_OF_DOCUMENT_STORE, END_OF_DOCUMENT_PACK = 0, 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_DOCUMENT_STORE)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.join(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.x, c.y, c.c = nx.n AND c.c = ny.n AS same FROM c JOIN n nx ON nx.doc_id = c.x JOIN n ny ON ny.doc_id = c.y
      WHERE c.c >= 0.8 * (nx.n + ny.n - c.c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
root AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
cnt AS (SELECT x, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_same FROM l GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(root.y, d.doc_id)) AS class_id, coalesce(cnt.n_links, 0) AS n_links, coalesce(cnt.n_same, 0) + 1 AS n_copies
FROM d LEFT JOIN root ON root.x = d.doc_id LEFT JOIN cnt ON cnt.x = d.doc_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_OF_DOCUMENT_PACK, with_ids=False)


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A conversation whose texts are control strings of a common template.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(planted)))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) + 4 AS tokens,
             23 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars FROM c),
t AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS upto, row_number() OVER w AS place FROM m
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
sys AS (SELECT conv_id, min(place) AS place, arg_min(tokens, place) AS tokens, arg_min(chars, place) AS chars FROM t WHERE role = 'system' GROUP BY conv_id),
x AS (SELECT t.*, coalesce(sys.tokens, 0) AS extra, sys.place AS sys_place, greatest((2048 - coalesce(sys.tokens, 0)) // 2, 256) AS stride
      FROM t LEFT JOIN sys ON sys.conv_id IS NOT DISTINCT FROM t.conv_id),
y AS (SELECT *, 2 * ((upto - 1) // stride) + CASE WHEN tokens > stride THEN 0 ELSE 1 END AS win FROM x),
sp AS (SELECT conv_id, win, min(upto - tokens) AS begin_at, min(place) AS first_place, greatest(0, least(256, 2048 - sum(tokens) - any_value(extra))) AS room,
              any_value(sys_place) AS sys_place FROM y GROUP BY ALL),
again AS (SELECT sp.conv_id, sum(t.chars) AS chars FROM sp JOIN t ON t.conv_id IS NOT DISTINCT FROM sp.conv_id AND t.place < sp.first_place
          AND sp.begin_at - (t.upto - t.tokens) <= sp.room AND t.place IS DISTINCT FROM sp.sys_place WHERE sp.room > 0 GROUP BY sp.conv_id),
kept AS (SELECT sp.conv_id, sum(sys.chars) AS chars FROM sp JOIN sys ON sys.conv_id IS NOT DISTINCT FROM sp.conv_id AND sp.first_place > sys.place GROUP BY sp.conv_id),
own AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM t GROUP BY conv_id)
SELECT own.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(own.chars + coalesce(again.chars, 0) + coalesce(kept.chars, 0) AS BIGINT) AS formatted_chars
FROM own LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM own.conv_id LEFT JOIN kept ON kept.conv_id IS NOT DISTINCT FROM own.conv_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("hits")).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
lens AS (SELECT DISTINCT n FROM wins),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT x.doc_id, x.i, x.n, wins.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM di) x JOIN wins ON wins.n = x.n AND wins.s = x.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(named.n_items, 0) AS n_items,
       coalesce(named.digest, sha256('')) AS items_sha256,
       coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select(
        "key.doc_id", quality.held_out(F.col("key.doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents"), licences.known_licences(spark), ["doc_id"])
    return found.select("doc_id", "licence", "n_lines", F.array_join("line_licences", ",").alias("line_licences"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op9_sql() -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), {_sql_text(licences.COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    spelt = "plain"
    for pattern, kept in licences.SPELLINGS:
        spelt = f"regexp_replace({spelt}, {_sql_text(pattern)}, {_sql_text(re.sub(r'[$]([0-9])', chr(92) + r'\1', kept))}, 'g')"
    known = ", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in licences.KNOWN)
    return f"""
WITH known AS (SELECT md5({spelt}) AS digest, min(licence) AS licence
               FROM (SELECT licence, {plain} AS plain FROM (VALUES {known}) v(licence, text)) WHERE plain <> '' GROUP BY 1),
units AS (SELECT doc_id, unnest(list_prepend(coalesce(text, ''), string_split(coalesce(text, ''), chr(10)))) AS text,
          unnest(range(0, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents),
hits AS (SELECT doc_id, line, licence FROM (SELECT doc_id, line, {plain} AS plain FROM units) u JOIN known ON known.digest = md5({spelt}) WHERE plain <> ''),
found AS (SELECT doc_id, min(licence) FILTER (WHERE line = 0) AS licence, count(*) FILTER (WHERE line > 0) AS n_lines,
          string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (WHERE line > 0) AS line_licences FROM hits GROUP BY doc_id)
SELECT d.doc_id, f.licence, coalesce(f.n_lines, 0) AS n_lines, coalesce(f.line_licences, '') AS line_licences
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.matched(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base, found = F.col("base"), pii.find(rows, pii.fit(rows))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), *[pii.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_oph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_dedup.dedup(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.x, c.y FROM c JOIN n nx ON nx.doc_id = c.x JOIN n ny ON ny.doc_id = c.y WHERE 100 * c.c >= 80 * (nx.n + ny.n - c.c)),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
root AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(root.y, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(root.y, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON root.x = d.doc_id
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
v AS (SELECT f.doc_id, f.term, w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * n.n * s.docs) // s.words))) AS v
      FROM f JOIN w ON w.term = f.term JOIN n ON n.doc_id = f.doc_id, s),
x AS (SELECT q.item_id, v.doc_id, CAST(sum(v.v) AS BIGINT) AS score FROM q JOIN v ON v.term = q.term GROUP BY ALL HAVING sum(v.v) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op13_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


OP13_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same,
             CAST(list_sum(list_transform(list_zip(a.x, e.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM a JOIN e ON a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_counting": op1_collision_counting,
    "op2_token_store": op2_token_store,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_kd_sharding": op5_kd_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_licence_scan": op9_licence_scan,
    "op10_personal_data": op10_personal_data,
    "op11_oph_dedup": op11_oph_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_segment_negatives": op13_segment_negatives,
}
ORACLES: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op6_chat_formatting": OP6_SQL, "op7_decontamination": OP7_SQL, "op9_licence_scan": _op9_sql(),
                           "op11_oph_dedup": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_segment_negatives": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
