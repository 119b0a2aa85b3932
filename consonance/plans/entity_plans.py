"""Registered queries for entity preparation, prompts, lookups and resume joins (B, C, A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed as EM
from ..operators import prep as P
from ..operators import vectors as V
from ..session import by_group
from ..sources.tables import table
from . import fixtures as FX
from .registry import register
from .statement_plans import SQL_STATEMENTS_CTE, sql_tokens

JUDGE_TEMPLATE = "Entity: {entity}\nReference document:\n{reference_doc}\nResponse:\n{response}\nLabel every statement."
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "d MMMM yyyy"]


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities = part names, first part key wins (B17), idx_cat = brand."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), F.col("p_partkey").alias("index"),
                                               F.col("p_brand").alias("idx_cat"))
    return P.keep_first(part, ["entity"], ["index"])


@register("b1_b8_entity_questions", sql="""
WITH e AS (SELECT p_name AS entity, arg_min(p_partkey, p_partkey) AS "index", arg_min(p_brand, p_partkey) AS idx_cat
           FROM part GROUP BY p_name),
q AS (SELECT *, 'Write a few paragraphs on ''' || entity || '''.' AS question FROM e)
SELECT "index", idx_cat, entity, question,
       trim(regexp_replace(replace(substr(question, instr(question, '''') + 1), '''', ''), '\\.+$', '')) AS recovered
FROM q""")
def entity_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + B17 + B8: one question per entity, and the entity recovered from the question."""
    e = _entities(spark, sf_dir).withColumn("question", P.entity_question(F.col("entity")))
    return e.select("index", "idx_cat", "entity", "question", P.entity_from_question(F.col("question")).alias("recovered"))


@register("b2_b3_generation_prompts", sql=f"""
WITH e AS (SELECT p_name AS entity, min(p_partkey) AS "index" FROM part GROUP BY p_name),
p AS (SELECT "index", '{P.DEFAULT_SYSTEM}' || chr(10) || chr(10) ||
             'Answer the open-ended question given between <question> tags in about 500 words. ' ||
             'Put the whole answer between one <response> and one </response> tag and use no other tags.' || chr(10) || chr(10) ||
             '<question>Write a few paragraphs on ''' || entity || '''.</question>' || chr(10) AS prompt FROM e)
SELECT "index", CAST(s.sample_idx AS INTEGER) AS sample_idx, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_chars
FROM p, range(0, 3) s(sample_idx)""")
def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + B3: generation prompt per entity, replicated 3 times."""
    e = _entities(spark, sf_dir)
    p = e.select("index", P.generation_prompt(P.entity_question(F.col("entity")), 500).alias("prompt"))
    r = P.replicate(p, 3)
    return r.select("index", F.col("sample_idx").cast("int").alias("sample_idx"), F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_chars"))


@register("b4_b6_judge_and_header", sql="""
WITH c AS (SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, text FROM conversations),
r AS (SELECT conv_id, text AS ref FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.response_idx,
       md5('Entity: conversation ' || c.conv_id || chr(10) || 'Reference document:' || chr(10) || r.ref || chr(10) ||
           'Response:' || chr(10) || c.text || chr(10) || 'Label every statement.') AS judge_md5,
       md5('The following is an excerpt from a text about: ''conversation ' || c.conv_id || ''' ' || chr(10) || chr(10) || ' ' || c.text) AS header_md5,
       md5('clustering: The following is an excerpt from a text about: ''conversation ' || c.conv_id || ''' ' || chr(10) || chr(10) || ' ' || c.text) AS header_nomic_md5
FROM c JOIN r USING (conv_id)""")
def judge_and_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 (judge prompt from a user template) + B6 (embedding header, with the task prefix)."""
    r = FX.conv_responses(spark, sf_dir).join(FX.reference_texts(spark, sf_dir), "conv_id")
    ent = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return r.select(*FX.RESP,
                    F.md5(P.judge_prompt(JUDGE_TEMPLATE, ent, F.col("reference"), F.col("response"))).alias("judge_md5"),
                    F.md5(P.embed_header(ent, F.col("response"))).alias("header_md5"),
                    F.md5(P.embed_header(ent, F.col("response"), "nomic-embed")).alias("header_nomic_md5"))


@register("b9_long_documents", sql="SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE length(text) > 5000")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-length filter (> 5000 characters)."""
    d = table(spark, sf_dir, "documents")
    return d.filter(F.length("text") > P.MIN_TEXT_CHARS).select("doc_id", "source", F.length("text").alias("n_chars"))


@register("b7_b10_book_entities", sql="""
WITH o AS (SELECT o.o_orderkey, o.o_orderpriority AS title, c.c_name AS author,
                  CASE o.o_orderstatus WHEN 'F' THEN strftime(o.o_orderdate, '%Y-%m-%d')
                                       WHEN 'O' THEN strftime(o.o_orderdate, '%m/%d/%Y')
                                       ELSE strftime(o.o_orderdate, '%-d %B %Y') END AS pub_date
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
p AS (SELECT *, coalesce(try_strptime(pub_date, '%Y-%m-%d'), try_strptime(pub_date, '%m/%d/%Y'),
                         try_strptime(pub_date, '%-d %B %Y')) AS pub_dt FROM o WHERE pub_date IS NOT NULL),
f AS (SELECT * FROM p WHERE pub_dt IS NOT NULL AND pub_dt > TIMESTAMP '2000-01-01'),
d AS (SELECT arg_min(o_orderkey, o_orderkey) AS o_orderkey, title, author, pub_dt FROM f GROUP BY title, author, pub_dt)
SELECT o_orderkey, replace(title, '''', '') || ' written by ' || replace(author, '''', '') || ' in the year ' || strftime(pub_dt, '%B %-d, %Y') AS entity,
       'Write a few paragraphs about the book ''' || title || ''' written by ' || author || ' in the year ' || strftime(pub_dt, '%B %-d, %Y') || '.' AS question
FROM d""")
def book_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10 (null drop, mixed-format date parse, > 2000-01-01, long format) + B17 + B7 + B1 (book form)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    text_date = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
                 .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy"))
                 .otherwise(F.date_format("o_orderdate", "d MMMM yyyy")))
    b = o.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("c_name").alias("author"),
                 text_date.alias("pub_date")).dropna(subset=["pub_date"])
    b = b.withColumn("pub_dt", P.parse_mixed_date(F.col("pub_date"), DATE_FORMATS))
    b = b.filter(F.col("pub_dt").isNotNull() & (F.col("pub_dt") > F.lit(P.DATE_CUTOFF).cast("timestamp")))
    b = P.keep_first(b.select("title", "author", "pub_dt", "o_orderkey"), ["title", "author", "pub_dt"], ["o_orderkey"])
    ds = P.long_date(F.col("pub_dt"))
    return b.select("o_orderkey", P.book_entity(F.col("title"), F.col("author"), ds).alias("entity"),
                    P.book_question(F.col("title"), F.col("author"), ds).alias("question"))


def _ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ents = (part.select(F.col("p_name").alias("entity"))
            .unionByName(part.select(F.col("p_type").alias("entity")))
            .unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("entity")))
            .unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity")))).distinct()
    first_names = part.select(F.col("p_type").alias("name"))
    places = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return P.ambiguity_flags(ents, "entity", first_names, places)


SQL_AMBIG = """
e AS (SELECT DISTINCT entity FROM (SELECT p_name AS entity FROM part UNION ALL SELECT p_type FROM part
      UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation)),
f AS (SELECT e.entity, len(string_split_regex(lower(trim(entity)), '\\s+')) = 1 AS one,
             lower(trim(entity)) IN (SELECT lower(trim(p_type)) FROM part) AS fn,
             lower(trim(entity)) IN (SELECT lower(trim(r_name)) FROM region) AS pl,
             lower(trim(entity)) AS n FROM e),
g AS (SELECT entity, one AND fn AS is_first_name, one AND (pl OR (n LIKE '%burg' AND length(n) > 4)) AS is_ambiguous_place FROM f)
"""


@register("b11_b12_ambiguity_flags", sql=f"WITH {SQL_AMBIG} SELECT * FROM g")
def ambiguity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11 + B12 with user lists (first names = part types, places = region names)."""
    return _ambiguity(spark, sf_dir)


@register("b13_filter_report", sql=f"""WITH {SQL_AMBIG}
SELECT count(*) AS total, CAST(sum(CAST(is_first_name OR is_ambiguous_place AS BIGINT)) AS BIGINT) AS filtered,
       CAST(sum(CAST(NOT (is_first_name OR is_ambiguous_place) AS BIGINT)) AS BIGINT) AS kept FROM g""")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply both filters and report the counts."""
    a = _ambiguity(spark, sf_dir).withColumn("_f", F.col("is_first_name") | F.col("is_ambiguous_place"))
    return a.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("_f").cast("long")).alias("filtered"),
                 F.sum((~F.col("_f")).cast("long")).alias("kept"))


@register("b14_b15_response_validity", sql="""
SELECT conv_id, CAST(turn AS INTEGER) AS response_idx,
       CASE WHEN text IS NULL OR text = '' THEN 'empty response'
            WHEN length(text) <= 100 THEN 'response too short' ELSE 'ok' END AS status
FROM conversations""")
def response_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B15 (skip empty) + B14 (> 100 characters) as a quarantine split."""
    r = FX.conv_responses(spark, sf_dir)
    nonempty, empty = P.split_valid(r, F.col("response").isNotNull() & (F.col("response") != ""), "empty response")
    ok, short = P.split_valid(nonempty, F.length("response") > P.MIN_RESPONSE_CHARS, "response too short")
    return ok.withColumn("status", F.lit("ok")).unionByName(short.withColumnRenamed("reason", "status")).unionByName(
        empty.withColumnRenamed("reason", "status")).select(*FX.RESP, "status")


@register("b17_first_part_per_brand", sql="""
SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand""")
def first_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedupe keeping the first row (by key order) per column subset."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return P.keep_first(p, ["p_brand"], ["p_partkey"])


@register("b18_dense_order_index", sql="""
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS row_idx FROM orders""")
def dense_order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense re-index in (date, key) order via range partitions + offsets, with a payload column."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return P.dense_index(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderpriority", "row_idx")


@register("b19_document_sample", sql="SELECT doc_id, source FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def document_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 100-document subset (the sampling operator itself)."""
    return P.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 100, seed=7)


SQL_SUBSET = """sub AS (SELECT conv_id, CAST(turn AS INTEGER) AS response_idx FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5('11|' || conv_id || '|' || turn), turn) <= 3)"""


@register("b20_group_subset", sql=f"WITH {SQL_SUBSET} SELECT conv_id, response_idx FROM sub")
def group_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 of K turns per conversation by seeded hash, chosen indices kept."""
    r = FX.conv_responses(spark, sf_dir).select("conv_id", "response_idx")
    return P.group_subset(r, ["conv_id"], "response_idx", 3, seed=11)


@register("c1_reference_join", sql="""
SELECT 'matched' AS side, doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)
UNION ALL
SELECT DISTINCT 'rejected', conv_id, NULL FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)""")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group → reference document by key; groups without one are rejected."""
    g = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m, rej = P.attach_reference(g, d, ["doc_id"])
    return m.select(F.lit("matched").alias("side"), "doc_id", F.md5("text").alias("text_md5")).unionByName(
        rej.select(F.lit("rejected").alias("side"), "doc_id", F.lit(None).cast("string").alias("text_md5")))


def _qa_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-PAGE as QA entries: titles = nav link texts then the page title; contexts = '' for
    links and the article paragraphs for the title; answer = <h1>; aliases = {title, h1}."""
    p = by_group(table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"])
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    h1 = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), 1)
    article = F.array_join(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1), "\n")
    return p.select("page_id", title.alias("entity"), F.concat(links, F.array(title)).alias("titles"),
                    F.concat(F.transform(links, lambda x: F.lit("")), F.array(article)).alias("contexts"),
                    h1.alias("answer"), F.array(title, h1).alias("aliases"))


SQL_QA = r"""
qa AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS entity,
              list_append(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), regexp_extract(html, '<title>(.*?)</title>', 1)) AS titles,
              list_append(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda x: ''),
                          array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), chr(10))) AS contexts,
              regexp_extract(html, '<h1>(.*?)</h1>', 1) AS answer,
              [regexp_extract(html, '<title>(.*?)</title>', 1), regexp_extract(html, '<h1>(.*?)</h1>', 1)] AS aliases
       FROM pages)
"""


def sql_embedding(x: str) -> str:
    buckets = f"list_transform({sql_tokens(x)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64)"
    return f"list_transform(range(0, 64), lambda b: CAST(len(list_filter({buckets}, lambda y: y = b)) AS DOUBLE))"


def sql_cosine(a: str, b: str) -> str:
    return (f"CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 "
            f"THEN list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) END")


@register("c2_c4_page_lookup", sql=f"""WITH {SQL_QA},
x AS (SELECT *, CAST(coalesce(list_position(list_transform(titles, lambda t: lower(trim(t))), lower(trim(entity))), 0) - 1 AS INTEGER) AS idx FROM qa)
SELECT page_id, idx AS entity_page_idx, md5(CASE WHEN idx >= 0 THEN contexts[idx + 1] END) AS page_md5,
       array_to_string(list_sort(list_intersect(list_transform(titles, lambda t: lower(t)), list_transform(aliases, lambda t: lower(t)))), '|') AS overlap
FROM x""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 (first case-insensitive title match, −1 if none) + C3 (page text) + C4 (titles ∩ aliases)."""
    q = _qa_entries(spark, sf_dir)
    idx = P.title_position(F.col("titles"), F.col("entity"))
    return q.select("page_id", idx.alias("entity_page_idx"),
                    F.md5(P.page_text(F.col("contexts"), idx)).alias("page_md5"),
                    F.array_join(F.array_sort(P.title_alias_overlap(F.col("titles"), F.col("aliases"))), "|").alias("overlap"))


@register("c5_c6_semantic_match", sql=f"""WITH {SQL_QA},
ov AS (SELECT page_id, answer, unnest(list_intersect(list_transform(titles, lambda t: lower(t)), list_transform(aliases, lambda t: lower(t)))) AS title FROM qa),
sc AS (SELECT page_id, title, {sql_cosine(sql_embedding('title'), sql_embedding('answer'))} AS score FROM ov),
best AS (SELECT page_id, arg_max(title, (score, title)) AS best_title, max(score) AS best_score FROM sc WHERE score > 0.75 GROUP BY page_id),
al AS (SELECT page_id, {sql_cosine(sql_embedding('entity'), sql_embedding('answer'))} AS align FROM qa)
SELECT al.page_id, best.best_title, round(best.best_score, 6) AS best_score, NOT (coalesce(al.align, 0) < 0.75) AS aligned
FROM al LEFT JOIN best USING (page_id)""")
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 (best overlapping title with similarity > 0.75, all overlaps scored) and
    C6 (entity/answer alignment ≥ 0.75), with the hashed-token embedder (F9) and F10."""
    q = _qa_entries(spark, sf_dir)
    ov = q.select("page_id", "answer", F.explode(P.title_alias_overlap(F.col("titles"), F.col("aliases"))).alias("title"))
    sc = ov.select("page_id", "title", V.cosine(EM.hashed_embedding(F.col("title")), EM.hashed_embedding(F.col("answer"))).alias("score"))
    best = sc.filter(F.col("score") > P.SIMILARITY_THRESHOLD).groupBy("page_id").agg(
        F.max_by("title", F.struct("score", "title")).alias("best_title"), F.max("score").alias("best_score"))
    al = q.select("page_id", V.cosine(EM.hashed_embedding(F.col("entity")), EM.hashed_embedding(F.col("answer"))).alias("align"))
    return al.join(best, "page_id", "left").select(
        "page_id", "best_title", F.round("best_score", 6).alias("best_score"),
        (~(F.coalesce("align", F.lit(0.0)) < P.SIMILARITY_THRESHOLD)).alias("aligned"))


@register("c7_c8_key_filters", sql="""
SELECT 'kept' AS kind, conv_id, CAST(turn AS INTEGER) AS response_idx FROM conversations WHERE conv_id IN (SELECT user_id FROM events)
UNION ALL
SELECT 'todo', conv_id, CAST(turn AS INTEGER) FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def key_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 (keep rows whose key is in a key set: event users) and C8 (drop keys already done:
    conversations with a system turn count as scored)."""
    r = FX.conv_responses(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"))
    kept = P.keep_keys(r, keys, ["conv_id"]).select(F.lit("kept").alias("kind"), *FX.RESP)
    done = r.filter(F.col("role") == "system").select("conv_id")
    todo = P.drop_done(r, done, ["conv_id"]).select(F.lit("todo").alias("kind"), *FX.RESP)
    return kept.unionByName(todo)


@register("c9_c10_resume_shortfall", sql="""
WITH have AS (SELECT conv_id, count(*) AS have FROM conversations GROUP BY conv_id),
exp AS (SELECT DISTINCT user_id AS conv_id, 5 AS n_expected FROM events),
j AS (SELECT exp.conv_id, n_expected, coalesce(have, 0) AS have FROM exp LEFT JOIN have USING (conv_id))
SELECT conv_id, CAST(have AS BIGINT) AS have, CAST(s.sample_idx AS INTEGER) AS sample_idx
FROM j, LATERAL (SELECT unnest(range(0, greatest(n_expected - have, 0))) AS sample_idx) s
WHERE have < n_expected""")
def resume_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 (keys absent or short: have < 5 turns) + C10 (the shortfall, replicated)."""
    existing = FX.conv_responses(spark, sf_dir).select("conv_id")
    expected = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id")).distinct().withColumn(
        "n_expected", F.lit(5))
    inc = P.incomplete_keys(expected, existing, ["conv_id"], "n_expected")
    s = P.shortfall(inc.select("conv_id", "n_expected"), existing, ["conv_id"], "n_expected")
    return s.select("conv_id", F.col("have").cast("long").alias("have"), F.col("sample_idx").cast("int").alias("sample_idx"))


@register("a7_reference_fetch", sql="""
WITH d AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, md5(html) AS n FROM pages),
e AS (SELECT DISTINCT regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages)
SELECT title, arg_max(n, page_id) AS text_md5 FROM d WHERE title IN (SELECT title FROM e) GROUP BY title""")
def reference_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title is in the entity set (semi-join), one text per title (last wins)."""
    p = table(spark, sf_dir, "pages")
    docs = p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
                    F.md5("html").alias("n"))
    ents = p.select(F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title")).distinct()
    m = docs.join(ents, "title", "left_semi")
    return m.groupBy("title").agg(F.max_by("n", "page_id").alias("text_md5"))


@register("a9_book_plot_lookup", sql="""
WITH b AS (SELECT o.o_orderkey, replace(o.o_orderpriority, '''', '') || ' written by ' || replace(c.c_name, '''', '') ||
                  ' in the year ' || strftime(o.o_orderdate, '%B %-d, %Y') AS entity,
                  'Order ' || o.o_orderkey || ' of ' || c.c_name AS plot
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT entity, arg_max(plot, o_orderkey) AS plot FROM b GROUP BY entity""")
def book_plot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity (B7 form) → plot; a repeated entity keeps its last row."""
    from ..sources import io as IO

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    b = o.select("o_orderkey", P.book_entity(F.col("o_orderpriority"), F.col("c_name"), P.long_date(F.col("o_orderdate"))).alias("entity"),
                 F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("c_name")).alias("plot"))
    return IO.lookup_last(b, ["entity"], "plot", "o_orderkey")


@register("b16_alias_remap", sql="""
SELECT c.c_custkey, coalesce(n.n_name, lower(cn.n_name)) AS entity
FROM customer c JOIN nation cn ON cn.n_nationkey = c.c_nationkey
LEFT JOIN nation n ON lower(n.n_name) = lower(cn.n_name) AND n.n_regionkey = 0""")
def alias_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased nation names as keys, fixed through an alias table (nations of region 0)."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.lower("n_name").alias("entity"))
    aliases = n.filter(F.col("n_regionkey") == 0).select(F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    return P.remap_aliases(c, "entity", aliases)


@register("f9_hashed_embeddings", sql=f"""
SELECT conv_id, CAST(turn AS INTEGER) AS response_idx, {sql_embedding('text')} AS embedding FROM conversations""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the default offline embedder over every turn (64 md5 buckets of token counts)."""
    r = FX.conv_responses(spark, sf_dir)
    return r.select(*FX.RESP, EM.hashed_embedding(F.col("response")).alias("embedding"))


@register("f2_cosine_kernel", sql=f"""
WITH e AS (SELECT conv_id, CAST(turn AS INTEGER) AS i, {sql_embedding('text')} AS v FROM conversations)
SELECT a.conv_id, a.i, b.i AS j, round({sql_cosine('a.v', 'b.v')}, 6) AS cos FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.i <= b.i
WHERE list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0""")
def cosine_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the cosine kernel of each conversation's turns (upper triangle), a table of K² entries by definition."""
    r = FX.conv_responses(spark, sf_dir)
    good, _rejected = V.normalize_rows(r.select(*FX.RESP, EM.hashed_embedding(F.col("response")).alias("vec")), "vec")
    k = V.cosine_kernel(good, ["conv_id"], "response_idx", "vec")
    return k.select("conv_id", "i", "j", F.round("cos", 6).alias("cos"))


@register("f7_kernel_moments_by_conversation", sql=f"""
WITH e AS (SELECT conv_id, CAST(turn AS INTEGER) AS i, {sql_embedding('text')} AS v FROM conversations),
p AS (SELECT a.conv_id, a.i, b.i AS j, {sql_cosine('a.v', 'b.v')} AS c FROM e a JOIN e b ON a.conv_id = b.conv_id
      WHERE list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0)
SELECT conv_id, CAST(count(*) FILTER (WHERE i = j) AS BIGINT) AS k, round(sum(c) FILTER (WHERE i = j), 6) AS trace,
       round(sum(c * c), 6) AS fro2, round(sum(c * c) / pow(count(*) FILTER (WHERE i = j), 2), 6) AS purity
FROM p GROUP BY conv_id""")
def kernel_moments_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kernel moments of each conversation's turns, by the direct form: its groups are small by construction."""
    r = FX.conv_responses(spark, sf_dir)
    good, _rejected = V.normalize_rows(r.select(*FX.RESP, EM.hashed_embedding(F.col("response")).alias("vec")), "vec")
    return V.group_spectra(good, ["conv_id"], "vec").select("conv_id", "k", *_r6("trace", "fro2", "purity"))


@register("c14_subset_claims", sql=f"""WITH {SQL_STATEMENTS_CTE}, {SQL_SUBSET}
SELECT conv_id, response_idx, count(*) AS n_claims FROM st JOIN sub USING (conv_id, response_idx) GROUP BY ALL""")
def subset_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 + B20: the claim (statement) lists of a seeded 3-of-K response subset, joined by key."""
    r = FX.conv_responses(spark, sf_dir).select("conv_id", "response_idx")
    keep = P.group_subset(r, ["conv_id"], "response_idx", 3, seed=11)
    st = FX.conv_statements(spark, sf_dir)
    return st.join(keep, ["conv_id", "response_idx"], "left_semi").groupBy("conv_id", "response_idx").agg(
        F.count(F.lit(1)).alias("n_claims"))
