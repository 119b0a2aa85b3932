import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
CLASHING = ("doc", "hits", "score", "key", "x", "id", "label", "text_key", "set_key", "shard", "slot", "spans", "base", "node", "w", "part", "_text", "size")


def prose(seed: int, n: int) -> str:
    """``n`` invented words, sentences of about ten."""
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "the", "or", "is", "mé", "lo", "ra", "ti", "sh", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 10 == 0 else w + "." if i % 10 == 9 else w for i, w in enumerate(words))


EDGE_ROWS = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "   \n\t ", "en", None, 6), (None, None, None, None, None), (None, "a row without an id", "en", "b", 19),
    (4, "one two", "en", "b", 7), (5, "one two", "fr", "b", 7), (6, prose(1, 60), "en", "c", 1), (6, prose(1, 60), "en", "c", 1),
    (7, prose(1, 60), "en", "d", 1), (8, prose(1, 60).replace("The", "An", 1) + " more words here", "en", "d", 1), (9, prose(2, 30_000), "en", "d", 1),
    (10, "mail a.b@c.org or +1 (555) 010-2030, 10.0.0.1, 4111 1111 1111 1111", "en", "d", 1), (11, "!!! ??? ...", "en", "d", 11),
    (12, "x" * 50_000, "en", "d", 50_000), (13, "日本語のテキスト。 é̀ 😀 \x00\x01 end", "ja", "e", 1), (None, "a row without an id", "en", "b", 19),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, DOC)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, prose(1, 20)), (2, "one two"), (3, None), (4, ""), (None, prose(9, 40)), (5, prose(1, 20)), (6, "!!")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(4, 14)] + [(None, 1, 0), (6, None, 0), (7, 5, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words_of(text):
    import re

    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
