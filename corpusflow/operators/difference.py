"""What changed between two versions of a manifest, as multisets of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpusflow.operators.unions import stack_rows


def row_changes(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every row that the versions do not hold equally often: its columns, ``n_old``, ``n_new`` and ``change``.

    ``change`` is ``added``, ``removed``, ``more`` or ``fewer``. Rows are equal where all columns are, nulls included. Each version
    is counted before its shuffle, so a row that a third of the table repeats is one row a task.
    """
    columns = list(columns or old.columns)
    side = lambda df, old_n, new_n: df.select(*columns, F.lit(old_n).cast("bigint").alias("_old"), F.lit(new_n).cast("bigint").alias("_new"))
    counted = stack_rows(side(old, 1, 0), side(new, 0, 1)).groupBy(*columns).agg(F.sum("_old").alias("n_old"), F.sum("_new").alias("n_new"))
    n_old, n_new = F.col("n_old"), F.col("n_new")
    change = F.when(n_old == 0, "added").when(n_new == 0, "removed").when(n_new > n_old, "more").otherwise("fewer")
    return counted.filter(n_old != n_new).withColumn("change", change)


def added_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new version beyond those of the old one, as often as they are there in excess."""
    return new.exceptAll(old.select(*new.columns))


def common_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both versions, as often as in the one that has them less often."""
    return new.intersectAll(old.select(*new.columns))
