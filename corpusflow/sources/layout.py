"""Tables stored by key, for joins that come back every night."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def store_by_key(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` in ``buckets`` files by ``key``, sorted, as a table of the session's catalogue; joins and aggregations on
    the key then read it as it lies.

    Rows go to their bucket's task before they are written, so a bucket is one file. The number of buckets is for good: tables
    that are to meet without a shuffle need the same one, about a task's worth of the larger table in each.
    """
    laid = df.repartition(buckets, F.col(key)).sortWithinPartitions(key)
    laid.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return stored(df.sparkSession, table)


def stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
