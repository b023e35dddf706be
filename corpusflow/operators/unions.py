"""Stacking tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

#: More partitions than any table has: coalescing to so many changes nothing.
UNCHANGED = 1 << 24


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, by column name; a column one of them lacks is null there.

    Spark 4.1 lets a union keep the partitioning its inputs share and then skips the shuffle above
    it. If a shuffle below is reused elsewhere in the plan the union falls back to a plain one
    while the skipped shuffle stays away, and rows of a key end up apart: wrong results without an
    error. Here the first table is passed through a ``coalesce`` that leaves its partitions as they
    are and hides their layout, so the inputs share none, whatever the setting is.
    """
    first, *rest = tables
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first.coalesce(UNCHANGED), *rest])
