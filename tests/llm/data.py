"""Small documents with all the odd cases, and plain versions of what operators do."""

from __future__ import annotations

import random

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, _text string, ids string, decoded string, spans int, rules int"


def documents(spark, rows, schema=DOCS):
    """``rows`` of (doc_id, text, lang, source); further columns have names that operators might use themselves."""
    full = [(i, t, lang, s, None if t is None else len(t), 7, "x", "y", "z", 1, 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, schema)


def odd(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "größe", "漢字"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(20_000)
    return [
        (1, prose(60), "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, "   ", None, "b"), (5, "12345 !!", "en", "b"),
        (6, long, "en", "a"), (7, long, "en", "a"), (7, long, "en", "a"), (8, "one", "en", "b"), (8, "two", "fr", "b"),
        (None, prose(50), "en", "a"), (None, None, None, None), (9, "x\ny  z\t", "en", "c"), (10, "\u2581 \u0000 𝄞", "en", "c"),
        (11, prose(60), None, None), (12, "token = abcdefgh12", "en", "a"),
    ]


def empty(spark):
    return documents(spark, [])
