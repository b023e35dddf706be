"""Ranking and filtering of finished hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions.text import detokenize
from corpusflow.operators.bleu import with_ngrams


def nbest_rank(
    hyps: DataFrame,
    item: list[str],
    hyp: str,
    score: Column,
    n: int,
    length: Column | None = None,
    min_len: int = 1,
    max_len: int = 200,
) -> DataFrame:
    """The n best hypotheses per item by ``score`` (see ``hypothesis_score``), equal scores by id.

    ``length`` counts tokens without the end symbol. The rank limit acts before the shuffle, so an
    item sends at most n rows per task however many hypotheses it has.
    """
    if length is not None:
        hyps = hyps.filter(length.between(min_len, max_len))
    scored = hyps.withColumn("score", score)
    order = Window.partitionBy(*item).orderBy(F.desc("score"), hyp)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def no_repeat_ngram(hyps: DataFrame, tokens: Column, n: int) -> DataFrame:
    """Drop hypotheses in which an n-gram comes twice; n = 0 keeps all."""
    if n == 0:
        return hyps
    grams = with_ngrams(hyps.withColumn("_g", tokens), "_g", n)
    longest = "_g" if n == 1 else f"_g_{n}"
    kept = grams.filter(F.size(F.array_distinct(longest)) == F.size(longest))
    return kept.drop("_g", *[f"_g_{k}" for k in range(2, n + 1)])


def one_best(hyps: DataFrame, item: list[str], hyp: str, tokens: str, score: Column) -> DataFrame:
    """Cleaned text of the best hypothesis of each item, the first one among equals."""
    order = Window.partitionBy(*item).orderBy(F.desc("_score"), hyp)
    ranked = hyps.withColumn("_score", score).withColumn("_rank", F.row_number().over(order))
    # The rank limit acts before the shuffle: an item sends one row per task, not all its tokens.
    return ranked.filter(F.col("_rank") == 1).select(*item, hyp, detokenize(F.col(tokens)).alias("text"))
