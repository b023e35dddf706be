"""The registry of samples as a stream: files of claims arrive, the newest claim of each id wins.

Each task folds the claims of an id before the shuffle, and the state store keeps one claim for each id. The winner
is the greatest (priority, claim), so files that come late, twice or in another order change nothing: whatever the
deliveries, the outcome is that of one batch over all files. State grows with the ids, as a registry does; nothing
ages out of it, for a late claim of an id must still lose to a newer one that was seen long ago.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusflow.functions.text import normalize_id


def newest(claims: DataFrame, columns: Sequence[str], key: str = "id", priority: str = "priority") -> DataFrame:
    """One row per normalised id: the claim with the highest priority, of equal ones the greatest by ``columns``.

    Works on a table and on a stream. A claim without an id claims nothing; one without a priority loses to any other.
    """
    keyed = claims.select(normalize_id(F.col(key).cast("string")).alias(key), F.struct(F.col(priority), *columns).alias("_claim"))
    best = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_claim").alias("_claim"))
    return best.select(key, *[F.col("_claim")[c].alias(c) for c in (priority, *columns)])


def claims_from_files(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 1_000) -> DataFrame:
    """Parquet files of claims as they arrive below ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def run_registry(claims: DataFrame, folder: str, columns: Sequence[str], key: str = "id", priority: str = "priority") -> None:
    """Take in all files that have arrived and stop; the next run goes on from there.

    A batch writes the ids it changed to a folder of its own number, so a batch that is run again after a failure
    writes the same rows in the same place.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(folder, "updates", f"batch={number}"))

    query = (
        newest(claims, columns, key, priority)
        .writeStream.outputMode("update")
        .option("checkpointLocation", os.path.join(folder, "progress"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def read_registry(spark: SparkSession, folder: str, columns: Sequence[str], key: str = "id", priority: str = "priority") -> DataFrame:
    """The registry after all batches so far: of the updates of an id, the last is the greatest too."""
    updates = spark.read.parquet(os.path.join(folder, "updates"))
    last = updates.groupBy(key).agg(F.max(F.struct(F.col(priority), *columns)).alias("_claim"))
    return last.select(key, *[_field(c) for c in (priority, *columns)])


def _field(name: str) -> Column:
    return F.col("_claim")[name].alias(name)
