"""Row filters and per-column defaults of manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Directions of the corpus, by release.
TO_ENGLISH = {
    1: ("fr", "de", "nl", "ru", "es", "it", "tr", "fa", "sv-SE", "mn", "zh-CN"),
    2: (
        "fr", "de", "es", "ca", "it", "ru", "zh-CN", "pt", "fa", "et", "mn", "nl", "tr", "ar", "sv-SE", "lv", "sl", "ta", "ja",
        "id", "cy",
    ),
}
FROM_ENGLISH = {
    1: (),
    2: ("de", "tr", "fa", "sv-SE", "mn", "zh-CN", "cy", "ca", "sl", "et", "id", "ar", "ta", "lv", "ja"),
}
VERSIONS = (2,)

# Default limits of a sample, in source frames, target tokens and target frames.
MAX_SOURCE, MAX_TARGET, MAX_TARGET_AUDIO = 6000, 1024, 1200
POSITION_LIMITS = {
    "st": (MAX_SOURCE, MAX_TARGET),
    "s2st": (MAX_SOURCE, MAX_TARGET_AUDIO),
    "tts": (MAX_TARGET, MAX_TARGET_AUDIO),
}


def select_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of one split; ``train`` also takes the corpus's own extension of it."""
    names = [split, "train_covost"] if split == "train" else [split]
    return df.filter(F.col(column).isin(*names))


def check_train_splits(splits: str) -> list[str]:
    """Comma-separated train splits; each must be named ``train...``."""
    names = splits.split(",")
    if not all(name.startswith("train") for name in names):
        raise ValueError(f"train splits must start with 'train': {splits}")
    return names


def valid_direction(df: DataFrame, source: str = "src_lang", target: str = "tgt_lang", version: int = 2) -> DataFrame:
    """Keep rows of an allowed direction: one side English, the other on the version's list."""
    if version not in VERSIONS:
        raise ValueError(f"version {version} is none of {VERSIONS}")
    src, tgt = F.col(source), F.col(target)
    into = (tgt == "en") & src.isin(*TO_ENGLISH[version])
    out_of = (src == "en") & tgt.isin(*FROM_ENGLISH[version])
    return df.filter(into | out_of)


def drop_undecodable(df: DataFrame, probe: Column, reason: str = "undecodable") -> tuple[DataFrame, DataFrame]:
    """Split on whether ``probe`` (null for a record that does not open) has a value."""
    bad = df.filter(probe.isNull()).withColumn("reason", F.lit(reason))
    return df.filter(probe.isNotNull()), bad


def with_optional(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Optional columns that are absent, or null in a row, take their default."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )


def all_or_nothing(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """An optional column counts only if every row of its split has it; else it is null there."""
    flags = df.groupBy(F.col(by).alias("_by")).agg(*[F.bool_and(F.col(c).isNotNull()).alias(f"_has_{c}") for c in columns])
    joined = df.join(flags, F.col(by).eqNullSafe(F.col("_by")), "left")
    kept = joined.withColumns({c: F.when(F.col(f"_has_{c}"), F.col(c)) for c in columns})
    return kept.drop("_by", *[f"_has_{c}" for c in columns])


def resolve_path(root: str, col: Column) -> Column:
    """Prefix a relative path with the audio root; an absolute one stays."""
    return F.when(col.startswith("/"), col).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), col))


def max_positions_filter(
    df: DataFrame,
    source_len: str,
    target_len: str,
    task: Column,
    limits: Mapping[str, tuple[int, int]] = POSITION_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): samples within the (source, target) limits of their task, and the rest.

    A length that is null has no limit to break. An unknown task is rejected.
    """

    def limit(side: int) -> Column:
        chain = F.lit(None).cast("bigint")
        for name, pair in limits.items():
            chain = F.when(task == name, F.lit(pair[side]).cast("bigint")).otherwise(chain)
        return chain

    def within(col: str, side: int) -> Column:
        return F.col(col).isNull() | (F.col(col) <= limit(side))

    known = limit(0).isNotNull()
    fits = F.coalesce(known & within(source_len, 0) & within(target_len, 1), F.lit(False))
    return df.filter(fits), df.filter(~fits)
