"""A permutation of 0..n-1 computed row by row: every epoch has its own order and none needs a sort.

Positions are laid on a grid of ``a`` columns and ``b`` rows, ``a * b >= n`` with less than ``a`` cells to spare. Rounds
add a hash of one coordinate to the other, alternately, which can be undone, so the grid is permuted; cells beyond n
walk on until they come back inside, which keeps it a permutation of n. Few cells are beyond, so few rows walk.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.hashing import bucket_hash

ROUNDS = 4
#: Cells beyond n that a walk may cross. There are fewer of them than this up to a million positions; with more positions
#: a walk this long has a chance below 1e-90, and would fail the job rather than repeat a position.
WALK = 1_000


def grid(n: int) -> tuple[int, int]:
    a = isqrt(max(n - 1, 0)) + 1
    return a, -(-max(n, 1) // a)


def _round(i: int, l: Column, r: Column, a: int, b: int, *parts) -> tuple[Column, Column]:
    if i % 2 == 0:
        return F.pmod(l + bucket_hash(*parts, i, r), F.lit(a)), r
    return l, F.pmod(r + bucket_hash(*parts, i, l), F.lit(b))


def _again(x: Column, a: int, b: int, *parts) -> Column:
    """All rounds as one expression, for the few cells that walk."""
    l, r = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a)).cast("bigint")
    for i in range(ROUNDS):
        l, r = _round(i, l, r, a, b, *parts)
    return l + F.lit(a) * r


def permute(df: DataFrame, position: str, n: int, seed: int, epoch: int, name: str = "pos") -> DataFrame:
    """Add ``name``: where a permutation that (seed, epoch) fixes sends ``position``, one of 0..n-1. A null stays null."""
    a, b = grid(n)
    x = F.col(position).cast("bigint")
    df = df.withColumns({"_l": F.pmod(x, F.lit(a)), "_r": F.floor(x / F.lit(a)).cast("bigint")})
    for i in range(ROUNDS):
        l, r = _round(i, F.col("_l"), F.col("_r"), a, b, seed, epoch)
        df = df.withColumn("_l", l) if i % 2 == 0 else df.withColumn("_r", r)
    df = df.withColumn("_at", F.col("_l") + F.lit(a) * F.col("_r"))
    step = lambda at, _: F.when(at < n, at).otherwise(_again(at, a, b, seed, epoch))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a))), F.col("_at"), step)
    df = df.withColumn("_at", F.when(F.col("_at") < n, F.col("_at")).otherwise(walked))
    lost = F.raise_error(F.lit("a walk of the permutation did not end")).cast("bigint")
    inside = F.when(F.col("_at") < n, F.col("_at")).when(F.col(position).isNull(), F.lit(None).cast("bigint")).otherwise(lost)
    return df.withColumn(name, inside).drop("_l", "_r", "_at")
