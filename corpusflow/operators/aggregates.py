"""Corpus statistics. All of them are partial aggregations: what is shuffled is one row per group and task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

# Contract for the per-dimension statistics: population deviation, kept above this floor.
STD_FLOOR = 1e-5

# Width of the exponent ranges log_sum_exp adds up separately.
_LOG_RANGE = 64.0


def token_vocab(df: DataFrame, tokens: Column) -> DataFrame:
    """Token counts, commonest first, equal counts by symbol."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "token")


def cmvn_stats(df: DataFrame, frame: Column) -> DataFrame:
    """Mean and deviation of each feature dimension over all frames (one vector per row).

    Vectors are summarised whole: a task's moments are one pair of vectors, merged without loss of precision, and no frame is
    spread into a row for each dimension. Frames are of one length, which the job checks; a frame that is null or has a null takes
    no part.
    """
    vectors = df.select(frame.cast("array<double>").alias("_v"))
    whole = vectors.filter(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull()))
    # By one key: without a frame there is then no row, where a summary of nothing would fail.
    moments = whole.select(array_to_vector("_v").alias("_v")).groupBy(F.lit(0).alias("_all")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_m"))
    flat = moments.select(vector_to_array("_m.mean").alias("mean"), vector_to_array("_m.variance").alias("var"), F.col("_m.count").alias("_n"))
    dims = flat.select("_n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "_s"))
    # The summary's variance is that of a sample.
    deviation = F.sqrt(F.col("_s.var") * (F.col("_n") - 1) / F.col("_n"))
    return dims.select("dim", F.col("_s.mean").alias("mean"), F.greatest(deviation, F.lit(STD_FLOOR)).alias("std"))


def _by_dimension(df: DataFrame, column: str, stats: DataFrame, term) -> DataFrame:
    """Apply ``term(x, mean, std)`` to each dimension; the statistics are one value of n_dims entries."""
    packed = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))))
    scaled = F.zip_with(F.col(column), F.col("_stats"), lambda x, s: term(x.cast("double"), s["mean"], s["std"]))
    return df.withColumn("_stats", packed.scalar()).withColumn(column, scaled).drop("_stats")


def cmvn_apply(df: DataFrame, column: str, stats: DataFrame | None) -> DataFrame:
    """Normalise a vector column; without statistics it stays."""
    return df if stats is None else _by_dimension(df, column, stats, lambda x, mean, std: (x - mean) / std)


def cmvn_invert(df: DataFrame, column: str, stats: DataFrame | None) -> DataFrame:
    """Undo :func:`cmvn_apply`."""
    return df if stats is None else _by_dimension(df, column, stats, lambda x, mean, std: x * std + mean)


def feature_range(df: DataFrame, **columns: Column) -> DataFrame:
    """Global minimum and maximum of each column, as one row."""
    return df.agg(
        *[agg(col).alias(f"{name}_{label}") for name, col in columns.items() for label, agg in (("min", F.min), ("max", F.max))]
    )


def batch_counts(df: DataFrame, batch: Sequence[str], length: str) -> DataFrame:
    """Tokens, sentences and longest sample per batch."""
    return df.groupBy(*batch).agg(
        F.sum(length).alias("ntokens"), F.count(F.lit(1)).alias("nsentences"), F.max(length).alias("max_len")
    )


def padding_waste(df: DataFrame, batch: Sequence[str], length: str) -> DataFrame:
    """Share of a batch's cells that hold padding."""
    counted = batch_counts(df, batch, length)
    cells = F.col("max_len") * F.col("nsentences")
    waste = F.when(cells > 0, 1 - F.col("ntokens") / cells).otherwise(F.lit(0.0))
    return counted.select(*batch, "nsentences", waste.alias("waste"))


def reduce_metrics(logs: DataFrame, losses: Sequence[str], sample_size: str = "sample_size") -> DataFrame:
    """Each ``*_loss`` summed over the logs and divided by the summed sample size, to 3 decimals.

    One row per key, without its ``_loss`` ending; a zero size gives 0.
    """
    sums = logs.agg(
        F.coalesce(F.sum(sample_size), F.lit(0)).cast("double").alias("_size"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in losses],
    )
    pairs = F.array(*[F.struct(F.lit(c.removesuffix("_loss")).alias("key"), F.col(c).cast("double").alias("v")) for c in losses])
    rows = sums.select("_size", F.explode(pairs).alias("_p"))
    value = F.when(F.col("_size") > 0, F.col("_p.v") / F.col("_size")).otherwise(F.lit(0.0))
    return rows.select(F.col("_p.key").alias("key"), F.round(value, 3).alias("value"), F.col("_size").alias("sample_size"))


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: Column, **extra: Column) -> DataFrame:
    """``ln(sum(exp(value)))`` per key in one pass, whatever the range of the values and the group size.

    Values are added up inside exponent ranges, which plain partial sums can do. Of a key's ranges
    only the highest and the one below it can count: what lies further down is smaller by a factor of
    exp(64) or more. Both are kept by plain maxima and sums. ``extra`` aggregates (sums) come along.
    """
    finite = F.when(value > float("-inf"), value)
    ranged = df.withColumn("_x", finite).withColumn("_range", F.floor(F.col("_x") / _LOG_RANGE).cast("bigint"))
    partial = ranged.groupBy(*keys, "_range").agg(
        F.sum(F.exp(F.col("_x") - F.col("_range") * _LOG_RANGE)).alias("_s"),
        *[F.sum(col).alias(name) for name, col in extra.items()],
    )
    # The range below the top is the highest one of the other parity, or it is empty.
    parity = F.pmod("_range", F.lit(2))
    halves = [F.when(parity == side, F.col("_range")) for side in (0, 1)]
    merged = partial.groupBy(*keys).agg(
        *[F.max(half).alias(f"_r{side}") for side, half in enumerate(halves)],
        *[F.max_by("_s", half).alias(f"_s{side}") for side, half in enumerate(halves)],
        *[F.sum(name).alias(name) for name in extra],
    )
    top = F.greatest("_r0", "_r1")
    parts = [F.coalesce(F.col(f"_s{side}") * F.exp((F.col(f"_r{side}") - top) * _LOG_RANGE), F.lit(0.0)) for side in (0, 1)]
    result = F.coalesce(F.ln(parts[0] + parts[1]) + top * _LOG_RANGE, F.lit(float("-inf")))
    return merged.select(*keys, *extra, result.alias("lse"))


def ensemble_logavg(df: DataFrame, keys: Sequence[str], log_prob: Column) -> DataFrame:
    """Average of the models' distributions in log space, per item and token."""
    summed = log_sum_exp(df, keys, log_prob, n_models=F.lit(1))
    return summed.select(*keys, "n_models", (F.col("lse") - F.ln(F.col("n_models"))).alias("log_prob"))


def average_best(df: DataFrame, group: str, loss: Sequence[Column], vector: str, k: int) -> DataFrame:
    """Average the vectors of the k best runs of a group, element by element.

    The rank limit is applied before the shuffle, so a group sends at most k rows per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*loss)))
    best = ranked.filter(F.col("_rank") <= k)
    dims = best.select(group, F.posexplode(vector).alias("dim", "_v"))
    return dims.groupBy(group, "dim").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def regression_errors(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Synthesis errors over valid positions, and their sum.

    Columns: frame, frame_gold, pitch, pitch_gold, energy, energy_gold, log_duration, duration_gold;
    with ``frame_post``, the prediction after the post-net, its error is added to the frame error.
    """

    def mse(a: str, b: Column) -> Column:
        return F.avg(F.pow(F.col(a) - b, F.lit(2.0)))

    l1 = F.avg(F.abs(F.col("frame") - F.col("frame_gold")))
    if "frame_post" in pairs.columns:
        l1 = l1 + F.avg(F.abs(F.col("frame_post") - F.col("frame_gold")))
    errors = pairs.groupBy(*by).agg(
        l1.alias("l1"),
        mse("log_duration", F.log1p(F.col("duration_gold").cast("double"))).alias("dur"),
        mse("pitch", F.col("pitch_gold")).alias("pitch"),
        mse("energy", F.col("energy_gold")).alias("energy"),
    )
    return errors.withColumn("total", F.col("l1") + F.col("dur") + F.col("pitch") + F.col("energy"))


def split_summary(df: DataFrame, split: str, length: Column, tokens: Column) -> DataFrame:
    """Samples, tokens, lengths and vocabulary size per split.

    Counts of the distinct tokens are taken per (split, token) first, so no split gathers its words.
    """
    group = F.struct(split).alias("_split")
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(length).alias("n_frames"),
        F.min(length).alias("min_len"),
        F.avg(length).alias("mean_len"),
        F.max(length).alias("max_len"),
    )
    per_token = df.select(group, F.explode(tokens).alias("token")).groupBy("_split", "token").agg(
        F.count(F.lit(1)).alias("_c")
    )
    vocab = per_token.groupBy("_split").agg(F.sum("_c").alias("n_tokens"), F.count(F.lit(1)).alias("vocab_size"))
    joined = sizes.join(vocab, "_split", "left").fillna(0, ["n_tokens", "vocab_size"])
    return joined.select("_split.*", *[c for c in joined.columns if c != "_split"])


def size_ratios(sizes: DataFrame, alpha: float) -> DataFrame:
    """Sampling ratio of each dataset: p = (n/N)^alpha, normalised, over its share n/N."""
    power = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    totals = sizes.groupBy().agg(F.struct(F.sum("n").alias("n"), F.sum(power).alias("power"))).scalar()
    held = sizes.withColumn("_t", totals)
    return held.withColumn("size_ratio", power / F.col("_t.power") * F.col("_t.n") / F.col("n")).drop("_t")
