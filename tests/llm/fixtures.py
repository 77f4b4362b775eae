"""Small awkward inputs for the operators."""

from __future__ import annotations

import random

WORDS = "the of and lantern river copper winter garden signal harbour thunder meadow ledger violet canyon marble".split()

# columns whose names the operators use inside
CLASHING = "words size kept _row key a b label n_words text_hash taken target shard slot row_id spans base cluster".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def awkward_rows(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls everywhere, empty and long texts, repeated rows, ties."""
    rng = random.Random(seed)
    long = prose(rng, 4_000)
    rows = [
        (1, "", "en", "s1"), (2, None, "en", "s1"), (3, " \n\t ", "en", None), (None, "text without an id", None, "s2"),
        (None, None, None, None), (4, "one", "en", "s2"), (5, "one two", "en", "s2"), (5, "one two", "en", "s2"),
        (6, long, "en", "s3"), (7, long, "en", "s3"), (8, long + " tail", "en", "s3"), (9, long.upper(), "de", "s3"),
        (10, "\x00 \u0085 ÀÉ ß 😀 ퟿", "fr", "s1"), (11, "x" * 5_000, "en", "s2"),
        (12, "a " * 3_000, "en", "s2"), (13, "Released under the MIT License.\nRelease", "en", "s1"),
        (14, "write to jane.doe@example.org or +1 (555) 010-2030, card 4111 1111 1111 1111, host 10.0.0.255", "en", "s1"),
        (15, "same\nsame\nsame\nother\n\n\n", "en", "s4"), (15, "another text under the same id", "en", "s4"),
    ]
    rows += [(100 + i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 5}") for i in range(30)]
    return [(*row, len(row[1]) if row[1] is not None else None) for row in rows]


def awkward(spark, rows: list[tuple] | None = None):
    """The rows as a table with columns of clashing names beside them."""
    docs = spark.createDataFrame(awkward_rows() if rows is None else rows,
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'extra' AS {name}")
    return docs.repartition(3)
