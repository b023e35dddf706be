"""Rows that every operator must bear: nulls, empty, wordless, repeated and very long texts, other columns."""

import random

_draw = random.Random(5)
STEMS = [a + b for a in ("al", "ber", "con", "dra", "eth", "fol", "gri", "hux") for b in ("en", "or", "ist", "um", "ay", "ock", "ile")]


def prose(n_words: int, draw: random.Random = _draw) -> str:
    return " ".join(draw.choice(STEMS) + draw.choice(STEMS) for _ in range(n_words))


LONG = prose(30_000)
BASE = prose(120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)

#: (doc_id, text, and columns whose names operators use inside)
ROWS = [
    (1, BASE, "a", 1, "x"),
    (2, BASE, "b", 2, None),
    (3, NEAR, None, 3, "y"),
    (4, None, "c", None, "z"),
    (5, "", "d", 5, "z"),
    (6, " \t\n ", "d", 6, "z"),
    (7, "!!! ???", "e", 7, "z"),
    (8, "one two", "e", 8, "z"),
    (9, "One  two", "e", 9, "z"),
    (9, "One  two", "e", 9, "z"),
    (None, "no id here but some words all the same", "f", 10, "z"),
    (None, None, "f", 11, "z"),
    (10, LONG, "g", 12, "z"),
    (11, LONG, "g", 13, "z"),
    (12, prose(50), "h", 14, "z"),
    (12, prose(50), "h", 15, "z"),
    (-3, prose(40) + " été Ñandú 日本語", "h", 16, "z"),
]
#: Runs of one class of characters that a page may be made of.
RUNS = [
    (13, "start" + " " * 1_000_000 + "end", "h", 15, "z"),
    (14, "line" + "\r\n" * 600_000, "h", 15, "z"),
    (15, "#" * 200_000 + "x" * 200_000 + "7" * 200_000, "h", 15, "z"),
]
SCHEMA = "doc_id long, text string, digest string, score int, k0 string"


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
