"""Text lines with their position in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusflow.functions.text import strip, words


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, value). Files stay splittable.

    Lines are numbered within their file block, in reading order, and each block learns from the
    block counts how many lines precede it; no file passes through one task.
    """
    block = ["file", "block"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    in_order = Window.partitionBy(*block).orderBy("_read")
    numbered = lines.withColumn("_read", F.monotonically_increasing_id()).withColumn(
        "_row", F.row_number().over(in_order) - 1
    )
    return numbered.join(starts, block).select(
        "file", (F.col("_start") + F.col("_row")).cast("bigint").alias("line_no"), "value"
    )


def read_reference_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a reference, stripped; blank lines keep their position."""
    return _over_files(numbered_lines(spark, path)).select("line_no", strip(F.col("value")).alias("text"))


def _over_files(lines: DataFrame) -> DataFrame:
    """Lines numbered over all files of a folder, in the order of their names.

    What is counted and ordered in one place is one row for each file.
    """
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(starts, "file").withColumn("line_no", (F.col("line_no") + F.col("_before")).cast("bigint")).drop("_before")


def read_reference_tsv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(line_no, text) of a named column of a reference in TSV form; positions count data lines, over all files of a folder.

    Every file has the header, as its writer leaves it.
    """
    lines = numbered_lines(spark, path)
    header = lines.filter("line_no = 0").select(F.split("value", "\t").alias("h"))
    at = header.groupBy().agg(F.max(F.array_position("h", column))).scalar()
    fields = F.split("value", "\t")
    missing = F.raise_error(F.lit(f"{path} has no column {column}")).cast("boolean")
    rows = lines.withColumn("_at", at.cast("int")).filter(F.when(F.col("_at") == 0, missing).otherwise(F.col("line_no") > 0))
    placed = _over_files(rows.withColumn("line_no", F.col("line_no") - 1))
    return placed.select("line_no", strip(F.coalesce(F.get(fields, F.col("_at") - 1), F.lit(""))).alias("text"))


def read_token_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, token): the first field of each line of a vocabulary or speaker list, over all files of a folder."""
    return _over_files(numbered_lines(spark, path)).select("line_no", F.get(words(F.col("value")), F.lit(0)).alias("token"))


def read_pairs_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected) of a headerless ``id<TAB>text`` file: lines must have exactly two fields."""
    lines = spark.read.text(path)
    fields = F.split("value", "\t")
    two = F.size(fields) == 2
    return lines.filter(two).select(fields[0].alias("id"), fields[1].alias("text")), lines.filter(~two)
