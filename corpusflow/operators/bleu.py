"""Corpus BLEU: n-grams are counted inside each sentence pair, then summed.

Contract: orders 1 to 4, one reference, matches clipped per sentence, exponential smoothing of
orders without a match, brevity penalty, 0 to 100. If no order has a match, or the corpus is too
short to have an order at all, the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusflow.functions.text import line_13a, numbered_13a

MAX_ORDER = 4


def with_ngrams(df: DataFrame, tokens: str, order: int = MAX_ORDER) -> DataFrame:
    """Add the n-grams of an array column as ``<tokens>_2`` ... ``<tokens>_<order>``.

    Each order is made from the one before it. Tokens hold no white space, so joining them with a
    space is unambiguous.
    """
    shorter = tokens
    for n in range(2, order + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        heads, tails = F.slice(shorter, F.lit(1), count), F.slice(tokens, F.lit(n), count)
        shorter = f"{tokens}_{n}"
        df = df.withColumn(shorter, F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b)))
    return df


def _sentence_matches(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Clipped matches of each order, for each sentence pair: rows x orders.

    ``words`` are the numbered tokens of all hypotheses and then of all references, ``sizes`` the tokens of each.
    """
    pairs = len(sizes) // 2
    pair = np.repeat(np.arange(len(sizes)) % pairs, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # tokens from here to the sentence's end
    n_ours, width = sizes[:pairs].sum(), words.max(initial=0) + 1
    out = np.zeros((pairs, MAX_ORDER), np.int64)
    # Grams are numbered within their pair, by hash and not by sorting.
    grams, start = pair, np.arange(len(words))
    for order in range(1, MAX_ORDER + 1):
        coded = pa.array(grams * width + words[start + order - 1]).dictionary_encode()
        grams, number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        at = np.searchsorted(start, n_ours)
        both = np.minimum(*[np.bincount(side, minlength=number) for side in (grams[:at], grams[at:])])
        owner = np.zeros(number, np.int64)
        owner[grams[:at]] = pair[start[:at]]
        out[:, order - 1] = np.bincount(owner, weights=both, minlength=pairs)
        # A longer gram can be on both sides only if the grams of this order that begin and end it are.
        shared = np.zeros(len(words) + 1, bool)
        shared[start] = both[grams] > 0
        goes_on = shared[start] & shared[start + 1] & (left[start] > order)
        grams, start = grams[goes_on], start[goes_on]
    return out


#: Bytes of sentence pairs whose n-grams are counted at a time; a longer pair is counted alone.
BYTES_AT_ONCE = 1 << 19


def _slices(hyp: pa.Array, ref: pa.Array) -> Iterator[slice]:
    """Runs of sentence pairs of about ``BYTES_AT_ONCE``."""
    ends = np.cumsum(sum(pc.binary_length(side).to_numpy(zero_copy_only=False).astype(np.int64) for side in (hyp, ref)))
    at = 0
    while at < len(ends):
        full = (ends[at - 1] if at else 0) + BYTES_AT_ONCE
        to = max(int(np.searchsorted(ends, full, "right")), at + 1)
        yield slice(at, to)
        at = to


def sentence_counts(lines: DataFrame, hyp: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, m1..m4, t1..t4, r1..r4) for each pair of lines (see ``line_13a``): matches and n-gram numbers of each order.

    The tokens and n-grams of a pair are counted where its lines are, so no key is needed and none can be wrong.
    """
    orders = range(1, MAX_ORDER + 1)
    schema = T.StructType([*lines.select(*by).schema.fields] + [T.StructField(f"{c}{n}", T.LongType()) for c in "mtr" for n in orders])

    def task(batches):
        for batch in batches:
            for run in _slices(batch.column(hyp), batch.column(ref)):
                part = batch.slice(run.start, run.stop - run.start)
                words, sizes = numbered_13a(pa.concat_arrays([part.column(c) for c in (hyp, ref)]))
                matches = _sentence_matches(words, sizes)
                columns = {b: part.column(b) for b in by} | {f"m{n}": pa.array(matches[:, n - 1]) for n in orders}
                for name, length in zip("tr", np.split(sizes, 2), strict=True):
                    columns |= {f"{name}{n}": pa.array(np.maximum(length - (n - 1), 0)) for n in orders}
                yield pa.RecordBatch.from_pydict(columns)

    return lines.select(*by, hyp, ref).mapInArrow(task, schema)


def _totals() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c)
    return [*[total(f"{c}{n}") for c in "mt" for n in range(1, MAX_ORDER + 1)], total("r1")]


def score_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score of each group from the counts of its sentences."""
    return _scored(counts.groupBy(*by).agg(*_totals()), by)


def score_grouping_sets(counts: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """The scores of several groupings at once, from one pass over the counts of sentences.

    A column that a grouping leaves out is null; ``level`` tells that null from a key that is null: it is the number of
    the columns left out read as bits, the first column's the highest (0 for the finest grouping).
    """
    wide = counts.groupingSets([[F.col(c) for c in one] for one in sets], *by).agg(F.grouping_id().alias("level"), *_totals())
    return _scored(wide.withColumn("level", F.col("level").cast("int")), [*by, "level"])


def _scored(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores from added-up counts."""
    orders = range(1, MAX_ORDER + 1)
    misses = F.lit(0)
    logs = F.lit(0.0)
    for n in orders:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        missed = (t > 0) & (m == 0)
        misses = misses + F.when(missed, 1).otherwise(0)
        precision = F.when(t == 0, F.lit(None)).when(missed, 100.0 / (F.pow(F.lit(2.0), misses) * t)).otherwise(100.0 * m / t)
        wide = wide.withColumn(f"p{n}", precision)
        logs = logs + F.ln(F.col(f"p{n}"))
    hyp_len, ref_len = F.col("t1"), F.col("r1")
    penalty = F.when(hyp_len == 0, 0.0).when(hyp_len >= ref_len, 1.0).otherwise(F.exp(1 - ref_len / hyp_len))
    any_match = F.col("m1") + F.col("m2") + F.col("m3") + F.col("m4") > 0
    score = F.when(any_match, F.coalesce(F.col("_bp") * F.exp(logs / MAX_ORDER), F.lit(0.0))).otherwise(F.lit(0.0))
    return wide.withColumn("_bp", penalty).select(
        *by,
        score.alias("bleu"),
        F.col("_bp").alias("brevity_penalty"),
        hyp_len.cast("bigint").alias("hyp_len"),
        ref_len.cast("bigint").alias("ref_len"),
        *[F.coalesce(F.col(f"p{n}"), F.lit(0.0)).alias(f"precision{n}") for n in orders],
    )


def corpus_bleu(
    pairs: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    key: str = "idx",
    by: Sequence[str] = (),
    laid: bool = False,
) -> DataFrame:
    """BLEU of the corpus, or of each group of it, from raw sentences.

    Raw sentences are what is shuffled, once, to spread them evenly: by a hash of the whole pair, for
    a layout left over from a join of few bytes would have too few tasks. ``key`` only adds to that
    hash; it need not be unique. Pairs that are spread by a shuffle of their own (``laid``) stay where they are.
    """
    return score_counts(_pair_counts(pairs, prediction, reference, key, by, laid), by)


def bleu_grouping_sets(
    pairs: DataFrame,
    by: Sequence[str],
    sets: Sequence[Sequence[str]],
    prediction: str = "prediction",
    reference: str = "reference",
    key: str = "idx",
) -> DataFrame:
    """:func:`corpus_bleu` for several groupings: sentences are shuffled and counted once for all of them."""
    return score_grouping_sets(_pair_counts(pairs, prediction, reference, key, by), by, sets)


def _pair_counts(pairs: DataFrame, prediction: str, reference: str, key: str, by: Sequence[str], laid: bool = False) -> DataFrame:
    if not laid:
        pairs = pairs.select(*by, prediction, reference, F.xxhash64(key, prediction, reference).alias("_lay")).repartition("_lay")
    # Arrow takes valid text only.
    lines = pairs.select(
        *by,
        *[
            line_13a(F.make_valid_utf8(F.coalesce(F.col(column), F.lit("")))).alias(side)
            for side, column in (("_hyp", prediction), ("_ref", reference))
        ],
    )
    return sentence_counts(lines, "_hyp", "_ref", by)
