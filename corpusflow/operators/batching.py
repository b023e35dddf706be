"""Batch planning: order, token budgets, padding, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions.arrays import pad_to
from corpusflow.functions.hashing import bucket_hash, digest
from corpusflow.operators.sequences import with_position

# Contract of the budget sampler: samples of one length bucket share batches.
BUCKET_WIDTH = 256
ROWS_PER_SALT = 100_000

BATCH_KEY = ("bucket", "salt", "batch")


def length_order(
    df: DataFrame,
    length: str,
    idx: str,
    shuffle: bool = False,
    seed: int = 1,
    epoch: int = 1,
    name: str = "pos"
) -> DataFrame:
    """Number the samples by falling length; ties in original order, or permuted for training."""
    tie = [digest(F.col(idx), seed, epoch), F.col(idx)] if shuffle else [F.col(idx)]
    return with_position(df, [], [F.col(length).desc(), *tie], name)


def epoch_shuffle(
    df: DataFrame, key: Sequence[str], seed: int, epoch: int, name: str = "pos"
) -> DataFrame:
    """Number the rows by a permutation that (seed, epoch) fixes; ``key`` is unique."""
    columns = [F.col(k) for k in key]
    return with_position(df, [], [digest(*columns, seed, epoch), *columns], name)


def token_batches(
    df: DataFrame,
    length: str,
    key: str,
    max_tokens: int,
    max_rows: int | None = None,
    width: int = BUCKET_WIDTH,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Assign each sample to a batch ``(bucket, salt, batch)`` of similar lengths.

    The longest sample times the rows of a batch stays within ``max_tokens`` unless the batch is
    one row. A crowded bucket is spread over salts of about ``rows_per_salt`` samples, so batches
    are numbered in small groups and only a salt's last batch may be short.
    """
    bound = F.greatest(F.ceil(F.col(length) / width), F.lit(1)).cast("bigint") * width
    rows = df.withColumn("bucket", bound)
    fit = F.col("bucket") <= max_tokens
    # At most max_tokens / width rows, whatever the table holds.
    crowds = rows.filter(fit).groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows"))
    rows = rows.join(F.broadcast(crowds), "bucket", "left")
    hashed = bucket_hash(F.col(key))
    salts = F.ceil(F.col("_rows") / rows_per_salt).cast("bigint")
    rows = rows.withColumn("salt", F.when(F.col("_rows").isNull(), hashed).otherwise(F.pmod(hashed, salts)))
    capacity = F.floor(F.lit(max_tokens) / F.col("bucket"))
    if max_rows is not None:
        capacity = F.least(capacity, F.lit(max_rows))
    order = Window.partitionBy("bucket", "salt").orderBy(F.desc(length), key)
    batch = F.floor((F.row_number().over(order) - 1) / F.greatest(capacity, F.lit(1))).cast("bigint")
    return rows.withColumn("batch", batch).drop("_rows")


def pad_collate(
    df: DataFrame, key: str, values: str, pad, batch: Sequence[str] = BATCH_KEY
) -> DataFrame:
    """One row per batch: samples by falling length, padded to the longest, with lengths and mask.

    A batch is small by construction: :func:`token_batches` bounds its cells.
    """
    size = F.size(values)
    rows = F.array_sort(F.collect_list(F.struct((-size).alias("neg"), F.col(key).alias("key"), F.col(values).alias("v"))))
    packed = df.groupBy(*batch).agg(rows.alias("_rows"), F.max(size).alias("_width"), F.sum(size).alias("ntokens"))
    width = F.col("_width")
    ticks = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
    return packed.select(
        *batch,
        F.transform("_rows", lambda r: r["key"]).alias("keys"),
        F.transform("_rows", lambda r: pad_to(r["v"], width, pad)).alias("tokens"),
        F.transform("_rows", lambda r: -r["neg"]).alias("lengths"),
        F.transform("_rows", lambda r: F.transform(ticks, lambda i: i <= -r["neg"])).alias("mask"),
        "ntokens",
        F.size("_rows").alias("nsentences"),
    )


def shard(df: DataFrame, n: int, k: int, batch: Column) -> DataFrame:
    """Shard k of n over batch numbers."""
    if not 0 <= k < n:
        raise ValueError(f"shard {k} of {n}")
    return df.filter(F.pmod(batch, F.lit(n)) == k)


def batch_number(batch: Sequence[str] = BATCH_KEY) -> Column:
    """A number for a composite batch key, to shard by."""
    return bucket_hash(*[F.col(c) for c in batch])
