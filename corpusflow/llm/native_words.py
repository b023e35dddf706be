"""Words of a text as column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.llm.tables import text_of

#: A word: a run of characters that are neither ASCII separators nor ASCII symbols.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, all other characters as they are; null as empty."""
    text = text_of(text)
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once. A column of an inner select would not do: the optimizer may
    write its expression into a lambda function, where it is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column | str) -> Column:
    """A 64-bit hash of each word, in order."""
    return F.transform(words(text), lambda word: F.xxhash64(word))


def gram_hashes(hashes: Column, size: Column, k: int) -> Column:
    """The hash of each run of ``k`` word hashes; the array has at least ``k``. ``hashes`` is a column or bound by ``let``."""
    return F.transform(F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))
