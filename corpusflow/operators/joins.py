"""Equi-joins of corpus tables. Join strategy and skew splitting are left to adaptive execution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.text import EOS, SPECIAL_SYMBOLS, UNK, normalize_id
from corpusflow.operators.sequences import Sequences


def join_translations(transcripts: DataFrame, translations: DataFrame) -> DataFrame:
    """Transcripts with their translation and split, by clip path."""
    left = transcripts.select("path", "sentence", "client_id")
    return left.join(translations.select("path", "translation", "split"), "path", "inner")


def override_target(df: DataFrame, target: DataFrame, key: str = "path", line: str = "line_no") -> DataFrame:
    """Replace ``translation`` by the text of ``target`` (key, text, line); the last line of a key wins.

    Of equal line numbers (several files) the greatest text wins. Rows without a target text go.
    """
    last = target.groupBy(key).agg(F.max(F.struct(line, "text"))["text"].alias("translation"))
    return df.drop("translation").join(last, key, "inner")


def require_alignment(samples: DataFrame, alignments: DataFrame, key: str = "id") -> DataFrame:
    """Samples that have an alignment."""
    return samples.join(alignments.select(key), key, "left_semi")


def missing_alignment(samples: DataFrame, alignments: DataFrame, key: str = "id") -> DataFrame:
    """Samples skipped for want of one."""
    return samples.join(alignments.select(key), key, "left_anti")


def complete_features(samples: DataFrame, features: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """A sample counts only if every feature table has it; their columns are joined on.

    An id that a table repeats fails the job.
    """
    for name, table in features.items():
        others = [c for c in table.columns if c != key]
        one = table.groupBy(key).agg(*[F.any_value(c).alias(c) for c in others], F.count(F.lit(1)).alias("_rows"))
        message = F.concat(F.lit(f"{name} repeats the id "), F.col(key).cast("string"))
        one = one.filter(F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        samples = samples.join(one.drop("_rows"), key, "inner")
    return samples


def merge_registry(
    source: DataFrame,
    target: DataFrame,
    source_columns: Sequence[str] = ("src_audio", "src_n_frames"),
    target_columns: Sequence[str] = ("tgt_audio", "tgt_n_frames", "pitch", "energy"),
    priority: str = "priority",
    key: str = "id",
) -> DataFrame:
    """One row per sample id from both sides; within a side the highest priority wins.

    ``priority`` stands for the order in which manifests would have been read; of equal priorities the greatest
    claim wins, compared column by column. Each side is down
    to one row per id before the join, so no id is hot in it. ``n_source``/``n_target`` report how
    many rows claimed the id.
    """

    def one_per_id(df: DataFrame, columns: Sequence[str], count: str) -> DataFrame:
        keyed = df.withColumn(key, normalize_id(F.col(key).cast("string")))
        picked = keyed.groupBy(key).agg(
            F.max(F.struct(F.col(priority).alias("_priority"), *columns)).alias("_row"), F.count(F.lit(1)).alias(count)
        )
        return picked.select(key, count, *[F.col("_row")[c].alias(c) for c in columns])

    merged = one_per_id(source, source_columns, "n_source").join(
        one_per_id(target, target_columns, "n_target"), key, "full_outer"
    )
    return merged.fillna(0, ["n_source", "n_target"])


# Which registry field fills which manifest column, by manifest layout.
LAYOUTS = {
    "s2s": {"src_audio": "src_audio", "src_n_frames": "src_n_frames"},
    "s2s_target": {"tgt_audio": "tgt_audio", "tgt_n_frames": "tgt_n_frames", "pitch": "pitch", "energy": "energy"},
    "speech2unigram": {"audio": "src_audio", "n_frames": "src_n_frames"},
    "tts": {"audio": "tgt_audio", "n_frames": "tgt_n_frames", "pitch": "pitch", "energy": "energy"},
}


def fill_manifest(
    manifest: DataFrame, registry: DataFrame, layout: str, key: str = "id", strict: bool = True
) -> DataFrame:
    """Fill manifest columns from the registry.

    The target columns of an s2s manifest are filled only if it has ``tgt_audio``. With ``strict``
    a sample that the registry does not know, or knows without a side wanted, fails the job,
    whichever columns are read afterwards; :func:`missing_from_registry` lists such samples.
    """
    fills = _fills(manifest, layout)
    wanted = {f"_reg_{field}": F.col(field) for field in set(fills.values())}
    known = registry.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in wanted.items()])
    joined = manifest.withColumn("_key", normalize_id(F.col(key).cast("string"))).join(known, "_key", "left")
    if strict:
        # A filter, for a checked column would be pruned when nobody reads it.
        message = F.concat(F.lit("sample not in the registry: "), F.coalesce("_key", F.lit("null")))
        absent = F.greatest(*[F.col(f"_reg_{field}").isNull() for field in _leads(fills)], F.lit(False))
        joined = joined.filter(F.when(absent, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    values = {column: F.col(f"_reg_{field}") for column, field in fills.items()}
    return joined.withColumns(values).drop("_key", *wanted)


def _leads(fills: Mapping[str, str]) -> list[str]:
    """The registry field that says whether a side is known, for each side wanted: its audio."""
    return [field for field in ("src_audio", "tgt_audio") if field in fills.values()]


def _fills(manifest: DataFrame, layout: str) -> dict[str, str]:
    fills = dict(LAYOUTS[layout])
    if layout == "s2s" and "tgt_audio" in manifest.columns:
        fills |= LAYOUTS["s2s_target"]
    return fills


def missing_from_registry(manifest: DataFrame, registry: DataFrame, layout: str, key: str = "id") -> DataFrame:
    """Manifest rows that :func:`fill_manifest` cannot fill."""
    known = registry.select(F.col(key).alias("_key"), *_leads(_fills(manifest, layout))).dropna().select("_key")
    keyed = manifest.withColumn("_key", normalize_id(F.col(key).cast("string")))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def align_by_position(predictions: DataFrame, references: DataFrame, idx: str = "idx") -> DataFrame:
    """Pair prediction N with reference N; both carry N, from the file name and the line number."""
    return predictions.join(references, idx, "inner")


def unpaired_positions(predictions: DataFrame, references: DataFrame, idx: str = "idx") -> DataFrame:
    """Positions that only one side has, and positions that come twice (``only_in`` "repeated")."""
    left = predictions.groupBy(idx).agg(F.count(F.lit(1)).alias("_p"))
    right = references.groupBy(idx).agg(F.count(F.lit(1)).alias("_r"))
    both = left.join(right, idx, "full_outer")
    side = F.when(F.col("_r").isNull(), "prediction").when(F.col("_p").isNull(), "reference")
    side = side.when((F.col("_p") > 1) | (F.col("_r") > 1), "repeated")
    return both.withColumn("only_in", side).filter(side.isNotNull()).select(idx, "only_in")


def paired_by_position(predictions: DataFrame, references: DataFrame, idx: str = "idx") -> DataFrame:
    """:func:`align_by_position` for sides that must pair up: a position that one side lacks fails the job.

    One full outer join both checks and pairs.
    """
    left = predictions.withColumn("_p", F.lit(True))
    both = left.join(references.withColumn("_r", F.lit(True)), idx, "full_outer")
    odd = F.col("_p").isNull() | F.col("_r").isNull()
    message = F.concat(F.lit("predictions and references do not pair up at position "), F.coalesce(F.col(idx).cast("string"), F.lit("null")))
    return both.filter(F.when(odd, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_p", "_r")


def attach_targets(df: DataFrame, tasks: Mapping[str, DataFrame], key: str = "id", name: str = "multitask") -> DataFrame:
    """Auxiliary targets per sample id (each task a table of key and ``target``); absent is null.

    A key that a task repeats keeps its greatest target, so samples are never multiplied.
    """
    for task, table in tasks.items():
        one = table.groupBy(key).agg(F.max("target").alias(f"_task_{task}"))
        df = df.join(one, key, "left")
    packed = F.struct(*[F.col(f"_task_{task}").alias(task) for task in tasks])
    return df.withColumn(name, packed).drop(*[f"_task_{task}" for task in tasks])


def encode_tokens(
    tokens: Sequences,
    vocab: DataFrame,
    samples: DataFrame,
    token: str = "token",
    eos: bool = True,
    unk_id: int = SPECIAL_SYMBOLS.index(UNK),
    eos_id: int = SPECIAL_SYMBOLS.index(EOS),
) -> DataFrame:
    """Token ids per sample with unknown fallback and the end symbol; counts of tokens and unknowns.

    ``samples`` holds the keys of all samples: one without tokens gets the end symbol alone. The
    vocabulary (token, id) is joined by its size: a commonest token may be a third of all rows, and
    adaptive execution splits its partition.
    """
    known = vocab.select(F.col("token").alias(token), F.col("id").alias("_id"))
    rows = tokens.df.join(known, token, "left")
    ids = F.array_sort(F.collect_list(F.struct(tokens.t, F.coalesce("_id", F.lit(unk_id)).alias("id"))))["id"]
    encoded = rows.groupBy(F.struct(*tokens.keys).alias("_sample")).agg(
        ids.alias("ids"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.when(F.col("_id").isNull(), 1).otherwise(0)).alias("n_oov"),
    )
    every = samples.select(F.struct(*tokens.keys).alias("_sample")).distinct()
    whole = every.join(encoded, "_sample", "left").select(
        "_sample.*",
        F.coalesce("ids", F.array().cast(encoded.schema["ids"].dataType)).alias("ids"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_oov", F.lit(0)).alias("n_oov"),
    )
    return whole.withColumn("ids", F.concat("ids", F.array(F.lit(eos_id)))) if eos else whole


def decode_ids(encoded: DataFrame, vocab: DataFrame, ids: str = "ids", name: str = "symbols", key: Sequence[str] = ("id",)) -> DataFrame:
    """The symbols behind an array of ids, in order: the inverse of :func:`encode_tokens`.

    An id that the vocabulary (token, id) lacks reads as the unknown symbol.
    """
    known = vocab.select(F.col("id").alias("_one"), F.col("token").alias("_symbol"))
    rows = encoded.select(F.struct(*key).alias("_sample"), F.posexplode(ids).alias("_at", "_one")).join(known, "_one", "left")
    symbol = F.struct("_at", F.coalesce("_symbol", F.lit(UNK)).alias("s"))
    back = rows.groupBy("_sample").agg(F.array_sort(F.collect_list(symbol))["s"].alias(name))
    whole = encoded.withColumn("_sample", F.struct(*key)).join(back, "_sample", "left").drop("_sample")
    return whole.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def speaker_column(df: DataFrame, speakers: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Add ``speaker_id`` from a table of (speaker, id)."""
    known = speakers.select(F.col("speaker").alias(speaker), F.col("id").alias("speaker_id"))
    return df.join(known, speaker, "left")
