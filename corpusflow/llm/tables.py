"""Tasks that walk over runs of equal keys, and rows kept or dropped by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.unions import stack_rows

#: Rows that a task hands back to Spark at a time.
CHUNK = 256


def text_of(column: Column | str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what a task makes of a piece stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal integer keys; the rows of a key are neighbours in the input."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[start].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def by_run(df: DataFrame, keys: list[str], order: str, fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over the rows of each key, in order. The caller bounds the size of a key."""
    def task(batches):
        for table in runs(batches, keys):
            yield fn(table)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(task, schema)


#: Stands for a null id in row keys; sorts last.
NO_ID = (1 << 63) - 1


def row_id(column: Column | str = "doc_id") -> Column:
    """The id of a row as a key that is never null."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NO_ID))


def _keyed(docs: DataFrame, key: list[Column]) -> tuple[DataFrame, list[str]]:
    """(row, k0, k1, ...): all columns of ``docs`` as one, out of the way of other names."""
    names = [f"k{i}" for i in range(len(key))]
    return docs.select(F.struct("*").alias("row"), *[k.alias(n) for k, n in zip(key, names, strict=True)]), names


def keep_rows(docs: DataFrame, key: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (k0, k1, ..., once), with all their columns.

    Where ``once`` is set only one of the rows with the key stays, the one with the least hash of the row.
    Texts are shuffled once, by the key.
    """
    keyed, names = _keyed(docs, key)
    hit = keyed.join(kept.hint("shuffle_hash"), names)
    one = hit.filter("once").groupBy(*names).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return stack_rows(hit.filter("NOT once").select("row.*"), one.select("row.*"))


def drop_rows(docs: DataFrame, key: list[Column], dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped`` (k0, k1, ...), with all their columns."""
    keyed, names = _keyed(docs, key)
    return keyed.join(dropped.hint("shuffle_hash"), names, "left_anti").select("row.*")
