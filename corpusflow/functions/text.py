"""Text normalisation, tokenisation and hypothesis clean-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# The characters that count as white space (those of Python's str.strip and str.split).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern: one property test and one range, which Java checks far faster than a list.
SPACE = r"(?U:[\s\x{1c}-\x{1f}])"

# Symbols of the scored vocabularies.
BOS, PAD, EOS, UNK = "<s>", "<pad>", "</s>", "<unk>"
SPECIAL_SYMBOLS = (BOS, PAD, EOS, UNK)
PIECE_MARKER = "▁"
NULL_INITIALS = ("NULLINIT", "nullinit")
LANGUAGE_TAG = r"^<lang:.*>$"

# The published mteval-13a rules, in the order they are applied. The first one lists
# the ASCII symbols other than ' . , - one by one (Java looks that up in a table) and does not pad blanks,
# which changes no token. The second looks for its rare character first and then behind it: at a
# character that is no digit, and not the last one padded, for a match of the rule took both.
MTEVAL_13A_RULES = (
    (r"""[!"#$%&()*+/:;<=>?@\[\\\]^_`{|}~]""", " $0 "),
    (r"[.,](?<=[^0-9][.,])(?<!\G[.,])", " $0 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# The same rules for RE2, which Arrow uses, and what a word must hold for one of them to change it.
RE2_13A_RULES = (
    (r"([!-&(-+/:-@\[-`{-~])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)
RULED_13A = r"[!-&(-,./:-@\[-`{-~]|[0-9]-"
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _swap(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def words(col: Column) -> Column:
    """Split on runs of white space; no empty words."""
    return F.array_remove(F.split(col, f"{SPACE}+"), "")


def normalize_line(col: Column, side: str = "reference") -> Column:
    """Strip; the prediction side is lowercased as well."""
    if side not in ("prediction", "reference"):
        raise ValueError(f"side is prediction or reference, not {side!r}")
    stripped = strip(col)
    return F.lower(stripped) if side == "prediction" else stripped


def normalize_id(col: Column) -> Column:
    """Remove every ``.mp3`` so that both sides of a corpus share a key."""
    return _swap(col, ".mp3", "")


def line_13a(col: Column) -> Column:
    """The line that the rules of 13a read: entities replaced, line ends joined (trailing white space is cut first, as the scorer does)."""
    # Few lines hold what is replaced here, and a search for one character is cheaper than a replacement that finds nothing.
    one_line = lambda c: _swap(_swap(c, "-\n", ""), "\n", " ")
    line = F.rtrim(col, F.lit(SPACES))
    marked = one_line(_swap(line, "<skipped>", ""))
    for entity, char in ENTITIES:
        marked = _swap(marked, entity, char)
    markup = F.contains(col, F.lit("&")) | F.contains(col, F.lit("<"))
    return F.when(markup, marked).when(F.contains(col, F.lit("\n")), one_line(line)).otherwise(col)


def tokenize_13a(col: Column) -> Column:
    """Tokens as the scorer counts them."""
    line = F.concat(F.lit(" "), line_13a(col), F.lit(" "))
    for pattern, replacement in MTEVAL_13A_RULES:
        line = F.regexp_replace(line, pattern, replacement)
    return words(line)


def numbered_13a(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`tokenize_13a` inside a task: numbers of all tokens of ``lines`` (see :func:`line_13a`), and the tokens of each line.

    Equal tokens have equal numbers. No rule reads past white space, so each distinct word is taken apart once.
    """
    said = pc.utf8_split_whitespace(lines)
    coded = said.flatten().dictionary_encode()
    vocabulary, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    ruled = pc.match_substring_regex(vocabulary, RULED_13A)
    pad, joint = pa.scalar(" ", vocabulary.type), pa.scalar("", vocabulary.type)
    padded = pc.binary_join_element_wise(pad, vocabulary.filter(ruled), pad, joint)
    for pattern, replacement in RE2_13A_RULES:
        padded = pc.replace_substring_regex(padded, pattern, replacement)
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(padded))
    plain = vocabulary.filter(pc.invert(ruled))
    number = pa.concat_arrays([plain, parts.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    # Of each distinct word: how many tokens, and where they begin in ``number``. White space at an end of a line leaves an empty word.
    by_rule = ruled.to_numpy(zero_copy_only=False)
    pieces = np.ones(len(vocabulary), np.int64)
    pieces[by_rule] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    first = np.empty(len(vocabulary), np.int64)
    for kind in (~by_rule, by_rule):
        first[kind] = np.cumsum(pieces[kind]) - pieces[kind]
    first[by_rule] += len(plain)
    pieces[pc.equal(vocabulary, joint).to_numpy(zero_copy_only=False)] = 0

    ends = np.concatenate([[0], np.cumsum(pieces[word])])
    tokens = number[np.repeat(first[word] - ends[:-1], pieces[word]) + np.arange(ends[-1])]
    last = np.cumsum(pc.list_value_length(said).to_numpy(zero_copy_only=False))
    return tokens, np.diff(ends[last], prepend=0)


def detokenize(tokens: Column) -> Column:
    """Pieces of a hypothesis to readable text."""
    text = F.array_join(tokens, "")
    for old, new in (("_", " "), (PIECE_MARKER, " "), (UNK, " "), (BOS, ""), (EOS, "")):
        text = _swap(text, old, new)
    return F.regexp_replace(text, "^ ", "")


def phoneme_string(symbols: Column) -> Column:
    """Symbols joined by spaces, end symbols left out."""
    return F.array_join(F.filter(symbols, lambda s: s != EOS), " ")


def asr_postprocess(tokens: Column, mode: str = "collapse", silence: str = "|") -> Column:
    """Recogniser tokens to a scored transcript; a failed (null) row scores as ''."""
    if mode not in ("collapse", "none"):
        raise ValueError(f"mode is collapse or none, not {mode!r}")
    text = F.array_join(tokens, "" if mode == "collapse" else " ")
    return F.coalesce(normalize_line(_swap(text, silence, " "), "prediction"), F.lit(""))


def merge_syllables(col: Column) -> Column:
    """Glue initial/final pieces up to the one that ends in a tone digit.

    A separator is wanted exactly after such a piece, so no running state is needed.
    """
    pieces = F.filter(words(col), lambda p: ~p.isin(*NULL_INITIALS))
    closed = F.transform(pieces, lambda p: F.when(p.rlike(r"\p{N}$"), F.concat(p, F.lit(" "))).otherwise(p))
    return F.rtrim(F.array_join(closed, ""))


def strip_tone(col: Column) -> Column:
    """Cut the last character of each syllable."""
    return F.array_join(F.transform(words(col), lambda s: F.substring(s, F.lit(1), F.length(s) - 1)), " ")


def strip_lang_tags(tokens: Column) -> Column:
    return F.filter(tokens, lambda s: ~s.rlike(LANGUAGE_TAG))
