"""Vocabulary and speaker lists, and their dense ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.text import SPECIAL_SYMBOLS
from corpusflow.operators.sequences import with_position
from corpusflow.operators.unions import stack_rows


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``symbol count`` lines, commonest first."""
    line = F.concat_ws(" ", "token", F.col("count").cast("string"))
    vocab.orderBy(F.desc("count"), "token").select(line.alias("value")).write.text(path)


def vocab_ids(
    vocab: DataFrame,
    order: Sequence[Column],
    specials: Sequence[str] = SPECIAL_SYMBOLS
) -> DataFrame:
    """(token, id): the special symbols first, then the tokens in ``order`` (their line order)."""
    placed = with_position(vocab, [], order, "_pos")
    ids = placed.select("token", (F.col("_pos") + len(specials)).alias("id"))
    first = vocab.sparkSession.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id bigint")
    return stack_rows(first, ids)


def speaker_ids(speakers: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """(speaker, id) from 0; by name unless an ``order`` such as the line number is given."""
    if order is None:
        speakers, order = speakers.select("speaker").distinct(), [F.col("speaker")]
    return with_position(speakers, [], order, "id").select("speaker", "id")


def write_speakers(df: DataFrame, path: str) -> None:
    """The distinct speakers, one per line."""
    df.select(F.col("speaker").alias("value")).distinct().orderBy("value").write.text(path)
