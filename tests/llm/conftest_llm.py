from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Columns whose names clash with those that operators use inside or return.
EXTRA = ("length", "_salt", "score", "evidence", "held_out", "predicted", "removed", "_doc", "_key", "parts", "whole", "row", "place", "repeated", "share", "fp", "size", "s", "a.b")

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), *((c, T.StringType()) for c in EXTRA)]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents of (doc_id, text[, lang, source]), with further columns of clashing names."""

    def make(rows):
        full = [(i, t, *(rest or ("en", "s")), None if t is None else len(t), *(None if c == "_salt" else f"own {c}" for c in EXTRA)) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


def words(n, seed, stem="w"):
    """n words of a pseudorandom text."""
    import random

    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(10**6)}" for _ in range(n))


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "Two words"),
    (6, "same text here"),
    (6, "same text here"),
    (7, "same text here"),
    (None, "no id but some text"),
    (8, "ünïcödé — “quotes” 漢字 İstanbul Σίσυφος 𝒳 <|endoftext|> a <|startoftext|>"),
    (9, "a  b   c\n\n\td e f  "),
    (10, "x" * 5000 + " " + "y " * 3000),
    (11, "don't we'll I'M 123 4567 -- !!! ...", None, None),
]
