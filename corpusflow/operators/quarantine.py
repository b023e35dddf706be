"""A user's per-record function over a table, with failures kept instead of fatal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def safe_map(
    df: DataFrame,
    fn: Callable[[object], object],
    column: str,
    value_type: T.DataType,
    name: str = "value",
    keep: bool = False,
) -> DataFrame:
    """Add ``name`` = fn(column) and ``error``: a record on which fn raises has a null value and the reason.

    Arrow batches. The record itself does not come back unless ``keep`` asks for it.
    """
    fields = [f for f in df.schema.fields if keep or f.name != column]
    schema = T.StructType([*fields, T.StructField(name, value_type), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for record in batch[column]:
                try:
                    values.append(fn(record))
                    errors.append(None)
                except Exception as failure:  # whatever the user's function does, the job goes on
                    values.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            kept = batch if keep else batch.drop(columns=column)
            yield kept.assign(**{name: pd.Series(values, index=batch.index, dtype=object), "error": errors})

    return df.mapInPandas(run, schema)


def for_scoring(mapped: DataFrame, name: str = "value") -> DataFrame:
    """A failed record scores as the empty string."""
    return mapped.withColumn(name, F.coalesce(name, F.lit("")))


def for_extraction(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): failed records are set aside with their reason."""
    return mapped.filter(F.col("error").isNull()).drop("error"), mapped.filter(F.col("error").isNotNull())
