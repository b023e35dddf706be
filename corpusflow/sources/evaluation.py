"""Files of the scoring step: predictions, pairs, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.sources.manifests import read_manifest_tsv, write_manifest

# Names of the predicted files, without and with a speaker.
EXACT_NAME = r"(?:^|/)(\d+)_pred\.wav$"
SPEAKER_NAME = r"(?:^|/)(\d+)_spk[^/]*_pred\.wav$"

PAIR_COLUMNS = ("idx", "prediction", "reference")


def prediction_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the predicted files; only the listing is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*_pred.wav").load(folder).select("path")


def _per_index(paths: DataFrame) -> DataFrame:
    exact = F.regexp_extract("path", EXACT_NAME, 1).try_cast("bigint")
    spoken = F.regexp_extract("path", SPEAKER_NAME, 1).try_cast("bigint")
    named = paths.select("path", exact.alias("e"), spoken.alias("s")).withColumn("idx", F.coalesce("e", "s"))
    return named.filter(F.col("idx").isNotNull()).groupBy("idx").agg(
        F.min(F.when(F.col("e").isNotNull(), F.col("path"))).alias("exact"),
        F.count("e").alias("n_exact"),
        F.min(F.when(F.col("s").isNotNull(), F.col("path"))).alias("spoken"),
        F.count("s").alias("n_spoken"),
    )


def list_predictions(paths: DataFrame) -> DataFrame:
    """(idx, path): the file named by its index alone, else its single speaker variant.

    Several files for an index, or indices that do not run from 0 without a gap, fail the job;
    :func:`prediction_problems` names them all.
    """
    found = _per_index(paths)
    ends = found.groupBy().agg(F.struct(F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))).scalar()
    several = F.col("n_exact") + F.col("n_spoken") > 1
    gap = F.col("_ends.last") + 1 != F.col("_ends.n")
    broken = F.concat(F.lit("several predictions of index "), F.col("idx").cast("string"))
    ok = F.when(several, F.raise_error(broken).cast("boolean")).when(
        gap, F.raise_error(F.lit("prediction indices have a gap")).cast("boolean")
    )
    checked = found.withColumn("_ends", ends).filter(ok.otherwise(F.lit(True)))
    return checked.select("idx", F.coalesce("exact", "spoken").alias("path"))


def prediction_problems(paths: DataFrame) -> DataFrame:
    """(idx, problem) for every index that breaks the listing: a gap before it, or a choice of files."""
    found = _per_index(paths)
    follows = found.select((F.col("idx") + 1).alias("idx"), F.lit(True).alias("_follows"))
    checked = found.join(follows, "idx", "left")
    several = (F.col("n_exact") == 0) & (F.col("n_spoken") > 1)
    extra = (F.col("n_exact") > 0) & (F.col("n_spoken") > 0)
    gap = F.col("_follows").isNull() & (F.col("idx") > 0)
    problems = F.array_compact(
        F.array(
            F.when(several, F.lit("several speaker variants")),
            F.when(extra, F.lit("speaker variant beside the plain file")),
            F.when((F.col("n_exact") > 1), F.lit("several plain files")),
            F.when(gap, F.lit("gap before this index")),
        )
    )
    return checked.select("idx", F.explode(problems).alias("problem"))


def save_pairs(pairs: DataFrame, path: str) -> None:
    """Save (idx, prediction, reference) so that scoring can start from it."""
    write_manifest(pairs, path, PAIR_COLUMNS, by=())


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Saved pairs; an empty side comes back as the empty string."""
    raw = read_manifest_tsv(spark, path, PAIR_COLUMNS)
    text = {c: F.coalesce(c, F.lit("")) for c in PAIR_COLUMNS[1:]}
    return raw.withColumns({"idx": F.col("idx").cast("bigint"), **text})


def write_transcripts(df: DataFrame, path: str, text: str = "text", order: tuple[str, ...] = ("idx",)) -> None:
    """Transcripts as lines in prediction order: the part files, in name order, hold it."""
    df.orderBy(*order).select(F.coalesce(text, F.lit("")).alias("value")).write.text(path)
