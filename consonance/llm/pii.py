"""Personal data: exact base patterns, and more spans from boosted trees over high-recall candidates.

Everything on the main path is Spark SQL: patterns are matched by the JVM's regex functions, positions
come from the lengths of the pieces between matches, and the boosted trees are trained by Spark ML
and then written as one SQL expression that scores candidate spans inside each row. No text is
shuffled; a row's result is computed in the row.

* Base spans (always kept): email, ip, card, phone by the patterns of ``BASE``, leftmost and not
  overlapping per kind, then validated (octets, digit counts, Luhn).
* Candidates: looser patterns (``LOOSE``) propose overlapping spans, e.g. each of two card numbers in a row, numbers
  without a plus, or addresses whose local part is not ASCII.
* Evidence (``_evidence``) labels candidates by what the trees do not see: words before the candidate (``FOR_PHONE``,
  ``AGAINST``), an address's domain, a phone's plus; and by validity (octets, Luhn, digit counts). A phone-like number with no
  evidence for or against it has no label. The trees' features are the format alone, without plus, domain and words, so a
  number without evidence is judged by how numbers with evidence are written.
* Trees are fitted on distinct texts that hold candidates, those whose hash falls into a share that is
  expected to hold ``train_docs`` of them (all, if fewer), one row each.
* Thresholds, one per kind: the least margin at which selected candidates reach ``precision``, counted over the labelled
  candidates of all documents, copies included. No candidates of both classes to fit on: nothing is added; no such margin for a kind:
  nothing of that kind.

The patterns read each text once: base spans and candidates are written as a table (with the rows, where they are to be
redacted), from which sample, thresholds and results are taken. Positions come from running sums in blocks of
``RUN`` matches, and texts are cut at spans in blocks of characters, so time grows in proportion to a text's matches
and not with their square.

Repeated groups in the patterns are written as plain character runs: separators that join two digits
(or labels) are first replaced, one for one, by a control character, so the JVM's matcher needs no
recursion on very long runs and positions stay as they are.

Null text counts as empty; spans are in code points, the end exclusive; repeated rows get the same
result; an empty table gives no rows; columns of the input are carried in a struct and cannot clash.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

KINDS = ("email", "ip", "card", "phone")
JOIN = "\x01"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind -> (cheap test on the text, separators to mark, pattern on the marked text).
BASE = {
    "email": (r"@", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
              r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"),
    "ip": (r"[0-9]\.[0-9]", None, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9]", r"(?<=[0-9])[ -](?=[0-9])", r"[0-9][0-9\x01]++"),
    "phone": (r"\+[0-9]", None, r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Kind -> (cheap test, loose pattern).
LOOSE = {
    "email": (r"@", r"""(?:\G|(?<![^\s<>"()@,;:]))[^\s<>"()@,;:]++@[^\s<>"()@,;:]*[A-Za-z0-9]"""),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"),
    "card": (r"[0-9]{4}", r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{12,19})(?![0-9])"),
    "phone": (r"[0-9]{4}", r"(?<![0-9])\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
CONTEXT = 24
#: Words shortly before a candidate that speak for a phone number, and against personal data of any kind.
FOR_PHONE = r"(?:\btel\b|phone|\bcall|\bfax\b|mobile|contact)"
AGAINST = r"(?:version|\bv$|\border\b|\bisbn\b|\bissn\b|serial|invoice|\bpage\b|\bref\b|build)"
FEATURES = ("sort", "digits", "length", "blanks", "dots", "dashes", "brackets", "runs", "longest", "luhn", "octets", "before")
RUN, CUT, LONG_CUT = 64, 4096, 1 << 20
SPAN = "array<struct<start:int,end:int,m:string,before:string>>"


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _running(values: Column, add, zero: Column) -> Column:
    """What comes before each element, combined by ``add``: within blocks of ``RUN``, then over the blocks, so an array is
    copied once per block and not once per element."""
    def scan(v: Column, first: Column) -> Column:
        return F.aggregate(v, F.array(first), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(RUN))
        return F.transform(starts, lambda i: F.slice(v, i + 1, F.lit(RUN)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, zero, add))
        return F.flatten(F.zip_with(parts, F.slice(scan(totals, zero), F.lit(1), F.size(parts)),
                                    lambda b, first: F.slice(scan(b, first), F.lit(1), F.size(b))))

    return _let(values, lambda v: _let(blocks(v), whole))


def _matches(text: Column, pattern: str, test: str) -> Column:
    """All matches of ``pattern`` with their places and the characters before them."""
    has = text.rlike(test)
    none = F.array().cast("array<string>")
    found = F.struct(F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("m"),
                     F.when(has, F.split(text, pattern, -1)).otherwise(none).alias("g"))
    pairs = _let(found, lambda f: F.zip_with(F.slice(f["g"], F.lit(1), F.size(f["m"])), f["m"], lambda g, m: F.struct(g.alias("g"), m.alias("m"))))

    def placed(ps: Column) -> Column:
        at = _running(F.transform(ps, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda a, b: a + b, F.lit(0))
        return F.zip_with(ps, at, lambda x, a: F.struct(
            (a + F.length(x["g"])).alias("start"), (a + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("m"),
            F.lower(F.right(x["g"], F.lit(CONTEXT))).alias("before")))

    return _let(pairs, placed).cast(SPAN)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(m)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _base_spans(found: Column, k: int) -> Column:
    good = F.filter(found, lambda s: _valid(KINDS[k], s["m"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def _candidates(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), _evidence(k, s).cast("double").alias("label"), *_features(k, s)))


def _columns(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc (all columns, or all but the text), key (hash of the text), base spans (start, kind, end), loose candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]
    d = docs.select(F.struct(*own).alias("doc") if own else F.struct(F.lit(None).alias("none")).alias("doc"), text.alias("text"))
    plain = F.translate(F.col("text"), JOIN, "\x02")
    spans, loose = [], []
    for k, kind in enumerate(KINDS):
        test, separators, pattern = BASE[kind]
        marked = F.when(F.col("text").rlike(test), F.regexp_replace(plain, separators, JOIN)).otherwise("") if separators else plain
        found = _matches(marked, pattern, test if not separators else ".")
        spans.append(_base_spans(found, k))
        loose.append(_candidates(_matches(F.col("text"), LOOSE[kind][1], LOOSE[kind][0]), k))
    one = F.struct(F.xxhash64("text").alias("key"), F.array_sort(F.concat(*spans)).alias("base"), F.concat(*loose).alias("loose"))
    return d.select("doc", F.inline(F.array(one)))  # evaluated once, whatever is asked of it


def _features(k: int, s: Column) -> list[Column]:
    """A candidate's format (no plus, no domain, no words before it)."""
    m, n = F.regexp_replace(s["m"], r"\A\+", ""), lambda chars: F.length(s["m"]) - F.length(F.translate(s["m"], chars, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    digits = F.length(_digits(m))
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    values = (
        F.lit(float(k)), digits, F.length(m), n(" "), n("."), n("-"), n("()"), F.size(runs), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        flag(F.when(digits.between(2, 40), _luhn(m)).otherwise(False)), flag(_valid("ip", m)),
        F.when(s["before"].rlike(r"[0-9]\W?\z"), 3.0).when(s["before"].rlike(r"[a-z]\z"), 2.0).when(s["before"].rlike(r"=\W*\z"), 1.0).otherwise(0.0))
    return [v.cast("double").alias(name) for v, name in zip(values, FEATURES)]


def _evidence(k: int, s: Column) -> Column:
    """1 for personal data, 0 against, null for neither."""
    kind, m = KINDS[k], s["m"]
    against = s["before"].rlike(AGAINST + r"\W*\z")
    if kind == "email":
        return F.when(m.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2}\z") & ~against, 1).otherwise(0)
    if kind in ("ip", "card"):
        return F.when(_valid(kind, m) & ~against, 1).otherwise(0)
    spoken = m.startswith("+") | s["before"].rlike(FOR_PHONE + r"\W*\w{0,4}\W*\z")
    return F.when(against | ~_valid(kind, m), 0).when(spoken, 1)


def _covered(c: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))


LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>|in|not in) (\S+?)\)$|^( *)Predict: (\S+)$")


def tree_sql(text: str, prefix: str) -> str:
    """One tree of Spark ML's description as a CASE expression over ``prefix.<feature>``."""
    lines = [x for x in (LINE.match(row) for row in text.splitlines()) if x]

    def node(i: int) -> tuple[str, int]:
        x = lines[i]
        if x[7] is not None:
            return f"{float(x[7])!r}D", i + 1
        yes, j = node(i + 1)
        no, j = node(j + 1)
        return f"CASE WHEN {prefix}.{FEATURES[int(x[3])]} {x[4]} {float(x[5])!r}D THEN {yes} ELSE {no} END", j

    return node(0)[0]


def margin_sql(model, prefix: str = "c") -> str:
    """The boosted sum of all trees as SQL."""
    parts = [f"{w!r}D * ({tree_sql(t.toDebugString, prefix)})" for t, w in zip(model.trees, model.treeWeights)]
    return " + ".join(parts)


def matched(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """The table of base spans and candidates, one row per row of ``docs``, written once."""
    return stored(_columns(docs, keep_text), "pii-matches")


def fit(found: DataFrame, train_docs: int = 20_000, trees: int = 12, depth: int = 3, precision: float = 0.98) -> tuple[str, dict[int, float]] | None:
    """(margin as SQL over ``c``, threshold per kind) from ``matched``, or None where nothing can be learnt."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    buckets = 1 << 20
    texts = found.filter(F.size("loose") > 0).select("key", "loose")
    n = texts.agg(F.approx_count_distinct("key")).first()[0]
    share = buckets if n <= train_docs else int(buckets * train_docs / n) + 1
    part = texts.filter(F.pmod(F.xxhash64("key"), F.lit(buckets)) < share).dropDuplicates(["key"])
    train = stored(part.select(F.explode("loose").alias("c")).filter("c.label is not null").select("c.*"), "pii-candidates")
    if train.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(train)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(vectors.coalesce(4))
    margin = margin_sql(model)
    bins = found.select(F.explode("loose").alias("c")).filter("c.label is not null").groupBy("c.kind", F.round(F.expr(margin), 2).alias("m")).agg(
        F.sum("c.label").alias("good"), F.count(F.lit(1)).alias("n"))
    thresholds: dict[int, float] = {}
    good, seen = dict.fromkeys(range(len(KINDS)), 0.0), dict.fromkeys(range(len(KINDS)), 0)
    for r in sorted(bins.collect(), key=lambda r: -r.m):  # at most a bin per kind and hundredth of the margin
        good[r.kind], seen[r.kind] = good[r.kind] + r.good, seen[r.kind] + r.n
        if good[r.kind] >= precision * seen[r.kind]:
            thresholds[r.kind] = r.m - 0.005
    return (margin, thresholds) if thresholds else None


def find(found: DataFrame, model: tuple[str, dict[int, float]] | None) -> DataFrame:
    """``doc``, ``base`` and ``spans`` of ``matched``: arrays of (start, kind, end), sorted; spans holds base and what the trees add."""
    base = F.col("base")
    if model is None:
        return found.select("doc", "base", base.alias("spans"))
    margin, thresholds = model
    least = "CASE c.kind " + " ".join(f"WHEN {k} THEN {t!r}D" for k, t in thresholds.items()) + " END"
    good = F.expr(f"filter(loose, c -> coalesce(({margin}) >= {least}, false))")
    fresh = F.filter(good, lambda c: ~_covered(c, base))
    added = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    one = F.struct(base.alias("base"), F.array_sort(F.array_distinct(F.concat(base, added))).alias("spans"))
    return found.select("doc", F.inline(F.array(one)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def _blocks(text: Column) -> Column:
    """The text in blocks of ``CUT`` characters, cut from longer ones (a cut takes time in proportion to its place)."""
    def cut(t: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(t, i + 1, F.lit(size)))

    return F.flatten(F.transform(cut(text, LONG_CUT), lambda b: cut(b, CUT)))


def _between(blocks: Column, a: Column, z: Column) -> Column:
    """The characters from ``a`` to ``z`` (exclusive) of a text in blocks."""
    first = F.floor(a / CUT).cast("int")
    parts = F.transform(F.sequence(first, F.greatest(F.floor((z - 1) / CUT).cast("int"), first)), lambda k: F.substring(
        F.coalesce(F.get(blocks, k), F.lit("")), F.greatest(a - k * CUT, F.lit(0)) + 1, F.least(z - k * CUT, F.lit(CUT)) - F.greatest(a - k * CUT, F.lit(0))))
    return F.when(z > a, F.array_join(parts, "")).otherwise("")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(x: Column) -> Column:
        ends = _running(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        # a span that begins before the end of those before it belongs to their run
        pieces = F.zip_with(x["spans"], ends, lambda s, before: F.when(s["start"] >= before, F.concat(
            _between(x["blocks"], before, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), _between(x["blocks"], last, F.greatest(x["n"], last)))

    one = F.struct(spans.alias("spans"), _blocks(text).alias("blocks"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, _let(one, replaced)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other columns as they are."""
    prepare(docs.sparkSession)
    rows = matched(docs)
    found = find(rows, fit(rows))
    text = redacted(F.col("doc.text"), F.col("spans")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
