"""Small tables with the awkward cases that every operator has to stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light window garden paper music north field water horse story table green morning letter".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, several scripts."""
    long = sentence(1, 12_000)
    near = long.split()
    near[77] = "changed"
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", None), (4, " ".join(near), None, "s", 3), (5, "short", "en", None, 5), (5, "short", "en", None, 5),
        (None, "text without id, and " + sentence(3, 30), "en", "s", 9), (None, None, None, None, None), (6, "Ünïcode 日本語 текст 😀 <|endoftext|> é\n\n  \t\nline", "xx", "s", 1),
        (7, sentence(9, 40), "en", "s", 1), (8, sentence(9, 40), "en", "t", 1), (9, "x" * 50_000, "en", "s", 1), (10, "\n" * 300, "en", "s", 1),
    ]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return documents(spark, [])
