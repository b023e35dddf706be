"""The registered queries: every operator bound to the test tables, with its SQL twin.

Bindings only. ``events`` per user stand in for frame sequences, ``embeddings`` for model states,
words for phones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read by name: ``t.events``."""

    spark: SparkSession
    folder: str
    #: What several parts of one query build on.
    shared: dict = field(default_factory=dict, compare=False, repr=False)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Register ``fn(tables) -> DataFrame`` under its own name, with the SQL that must agree."""

        def register(fn):
            key = name or fn.__name__
            self.queries[key] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.sql[key] = sql
            return fn

        return register


def load() -> Catalog:
    from corpusflow.catalog import aggregations, batches, forms, io, jobs, joins, mechanisms, rows, sequences, text

    merged = Catalog()
    for module in (io, rows, joins, aggregations, sequences, batches, text, jobs, forms, mechanisms):
        merged.queries |= module.catalog.queries
        merged.sql |= module.catalog.sql
    return merged
