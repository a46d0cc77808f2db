import random

import pytest
from pyspark.sql import functions as F

CLASHING = ["id", "n", "k1", "rep", "quality", "surprise", "rules", "kept", "mix", "tokens", "score", "at", "pid", "base", "Words", "block", "row"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "er", "ing", "tion", "st", "ou", "ha", "re", "ly"]
    out = []
    for i in range(words):
        out.append("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + (".\n" if i % 9 == 8 else ""))
    return " ".join(out).replace("\n ", "\n")


def near(text: str, seed: int, changes: int = 1) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{seed}"
    return " ".join(words)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of given texts; a text may be a (doc_id, text, lang, source) tuple."""

    def make(rows):
        full = [x if isinstance(x, tuple) else (i, x, "en", "s0") for i, x in enumerate(rows)]
        return spark.createDataFrame([(*x, len(x[1] or "")) for x in full], DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(spark, make_docs):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns of clashing names."""
    a, b = prose(1, 120), prose(2, 90)
    rows = [
        (1, a, "en", "s0"), (1, a, "en", "s0"), (2, near(a, 5), "en", "s1"), (3, b, "de", "s0"), (4, None, "en", "s0"), (5, "", None, "s0"),
        (6, " \t\n ", "en", None), (None, b, "en", "s0"), (7, prose(3, 30_000), None, None), (8, "a " * 100_000, "en", "s1"), (9, "x" * 300_000, "en", "s1"),
        (10, "héllo wörld 漢字 𝒳 <|endoftext|> <|im_end|>", "fr", "s2"), (11, "one two", "fr", "s2"), (12, "one two", "fr", "s2"), (13, "\u0000\u0085﻿", "fr", "s2"),
    ]
    docs = make_docs(rows)
    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))

    return make
