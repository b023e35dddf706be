"""Feature tables: one row per sample id with its frames x dims matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.arrays import transpose


def write_features(df: DataFrame, path: str, frames: str = "frames") -> None:
    """Dump each sample's matrix transposed, dims x frames."""
    df.withColumn(frames, transpose(F.col(frames))).write.parquet(path)


def feature_index(features: DataFrame, key: str = "id", frames: str = "frames") -> DataFrame:
    """(id, location, n_frames) of a stored feature table."""
    return features.select(
        F.col(key), F.col("_metadata.file_path").alias("location"), F.size(frames).cast("bigint").alias("n_frames")
    )
