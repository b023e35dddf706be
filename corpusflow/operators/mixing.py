"""Chaining, mixing and resampling of datasets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.hashing import HASH_RANGE, bucket_hash, keep_fraction
from corpusflow.operators.filters import POSITION_LIMITS, max_positions_filter
from corpusflow.operators.sequences import with_position
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written


def concat_splits(tables: Mapping[str, DataFrame], splits: str, column: str = "split") -> DataFrame:
    """Chain the comma-separated splits, each row tagged; a column one split lacks is null there."""
    tagged = [tables[name].withColumn(column, F.lit(name)) for name in splits.split(",")]
    return stack_rows(*tagged)


def sample_copies(df: DataFrame, key: Sequence[str], ratio: float, seed: int = 1, epoch: int = 1) -> DataFrame:
    """Each row ``floor(ratio)`` times and once more for the fraction, numbered in ``copy``."""
    whole = math.floor(ratio)
    columns = [F.col(k) for k in key]
    extra = F.when(keep_fraction(ratio - whole, *columns, seed, epoch), 1).otherwise(0)
    copies = F.lit(whole) + extra
    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("copy", F.explode(numbers))


def mix_modalities(
    sets: Mapping[str, DataFrame],
    ratios: Mapping[str, float],
    key: Sequence[str] = ("id",),
    lengths: tuple[str, str] | None = None,
    limits: Mapping[str, tuple[int, int]] = POSITION_LIMITS,
    seed: int = 1,
    epoch: int = 1,
) -> tuple[DataFrame, DataFrame | None]:
    """(mix, rejected): every modality under its own limits and sample ratio, tagged, and what the limits reject.

    Without ``lengths`` nothing is rejected. An evaluation set is the mix of a single modality.
    """
    parts, rejected = [], []
    for name, df in sets.items():
        if lengths is not None:
            df, long = max_positions_filter(df, *lengths, task=F.lit(name), limits=limits)
            rejected.append(long.withColumn("modality", F.lit(name)))
        parts.append(sample_copies(df, key, ratios.get(name, 1.0), seed, epoch).withColumn("modality", F.lit(name)))
    return stack_rows(*parts), stack_rows(*rejected) if rejected else None


def resample(
    df: DataFrame,
    dataset: str,
    key: Sequence[str],
    ratios: DataFrame,
    seed: int = 1,
    epoch: int = 1,
) -> DataFrame:
    """``ceil(n * size_ratio)`` draws from each dataset, numbered in ``draw``.

    Below 1 without replacement: the first draws of a fixed permutation. From 1 on with
    replacement: every draw picks a row by hash. ``ratios`` has (dataset, n, size_ratio). Rows are
    numbered once, each row then issues its share of the draws, and draws find their row by an
    equi-join on (dataset, number).
    """
    columns = [F.col(k) for k in key]
    order = [bucket_hash(*columns, seed, epoch), *columns]
    placed = written(with_position(df, [dataset], order, "_pos"), "placed")
    sizes = ratios.select(F.col(dataset).alias("_dataset"), F.col("n").alias("_n"), F.col("size_ratio").alias("_r"))
    placed = placed.join(sizes, F.col(dataset).eqNullSafe(F.col("_dataset"))).drop("_dataset")
    placed = placed.withColumn("_size", F.ceil(F.round(F.col("_n") * F.col("_r"), 9)).cast("bigint"))
    once = placed.filter((F.col("_r") < 1) & (F.col("_pos") < F.col("_size"))).withColumn("draw", F.col("_pos"))

    again = placed.filter(F.col("_r") >= 1)
    first = F.ceil(F.col("_pos") * F.col("_size") / F.col("_n")).cast("bigint")
    last = F.ceil((F.col("_pos") + 1) * F.col("_size") / F.col("_n")).cast("bigint") - 1
    draws = again.select(dataset, "_n", F.explode(F.sequence(first, last)).alias("draw"))
    target = F.floor(bucket_hash(F.col(dataset), F.col("draw"), seed, epoch) * F.col("_n") / HASH_RANGE).cast("bigint")
    draws = draws.select(F.col(dataset).alias("_dataset"), "draw", target.alias("_at"))
    same = F.col(dataset).eqNullSafe(F.col("_dataset")) & (F.col("_pos") == F.col("_at"))
    picked = draws.join(again, same).drop("_dataset", "_at")
    return stack_rows(once, picked).drop("_pos", "_n", "_r", "_size")


def dataset_sizes(df: DataFrame, dataset: str | Column) -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))
