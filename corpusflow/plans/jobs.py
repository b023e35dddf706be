"""The corpus jobs end to end: target manifest, speech-to-speech manifest, scoring, training batches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.arrays import array_sum, format_durations
from corpusflow.functions.text import asr_postprocess, merge_syllables, normalize_id, normalize_line
from corpusflow.operators import alignment, batching, bleu, joins, mixing
from corpusflow.operators.aggregates import token_vocab
from corpusflow.operators.filters import POSITION_LIMITS, select_split
from corpusflow.operators.sequences import Sequences
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written
from corpusflow.sources.evaluation import list_predictions
from corpusflow.sources.manifests import write_manifest
from corpusflow.sources.vocab import write_speakers, write_vocab


def tts_phones(
    intervals: Sequences,
    pitch: Sequences,
    energy: Sequences,
    rate: float,
    hop: int,
    silence: tuple[str, ...] = alignment.SILENCE_PHONES,
) -> Sequences:
    """Trimmed phones of each sample in long form: duration, and pitch and energy averaged over it (in log)."""
    keys = list(intervals.keys)
    trimmed = alignment.trim_silence(alignment.frame_durations(intervals, rate, hop), silence=silence)
    placed = alignment.offsets(trimmed)
    # Written once: the segments go to both series and the phones to the result.
    phones = written(placed.df.select(*keys, "pos", "phone", "duration", "start_sec", "end_sec", "start_frame", "end_frame"), "phones")
    segments = phones.select(*keys, F.col("pos").alias("seg"), "start_frame", "end_frame")
    sample = F.struct(*keys)
    rows = phones.withColumn("_sample", sample)
    for name, series in (("pitch", pitch), ("energy", energy)):
        means = alignment.segment_mean(series, segments, "value", log_scale=True)
        means = means.select(sample.alias("_sample"), F.col("seg").alias("pos"), F.col("mean").alias(name))
        rows = rows.join(means, ["_sample", "pos"])
    return Sequences(rows.drop("_sample"), tuple(keys), "pos")


def tts_manifest(
    samples: DataFrame,
    intervals: Sequences,
    pitch: Sequences,
    energy: Sequences,
    rate: float,
    hop: int,
    silence: tuple[str, ...] = alignment.SILENCE_PHONES,
    features: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Manifest of the target side from aligned samples and frame-level pitch and energy.

    ``samples`` holds the keys and what the manifest carries on (audio, speaker, source text); each
    of ``features`` (one key, its columns) narrows them to the samples it has. A sample without an
    alignment is left out; :func:`~corpusflow.operators.joins.missing_alignment` lists them. A sample
    that is silent throughout stays, with empty arrays and ``all_silent``. No limit on phones: limits
    belong to training. A manifest holds a sample in a row; :func:`tts_phones` is the long form.
    """
    keys = list(intervals.keys)
    sample = F.struct(*keys).alias("_sample")
    arrays = tts_phones(intervals, pitch, energy, rate, hop, silence).arrays("phone", "duration", "pitch", "energy", "start_sec", "end_sec")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    aligned = intervals.df.select(sample).distinct().join(arrays.withColumn("_sample", sample).drop(*keys), "_sample", "left")
    manifest = aligned.select(
        F.col("_sample"),
        F.coalesce(array_sum(F.col("duration")), F.lit(0)).cast("bigint").alias("n_frames"),
        F.coalesce(F.array_join("phone", " "), F.lit("")).alias("tgt_text"),
        F.coalesce(format_durations(F.col("duration")), F.lit("")).alias("duration"),
        F.coalesce("pitch", empty("double")).alias("pitch"),
        F.coalesce("energy", empty("double")).alias("energy"),
        F.coalesce(F.get("start_sec", F.lit(0)), F.lit(0.0)).alias("start_sec"),
        F.coalesce(F.get("end_sec", F.lit(0)), F.lit(0.0)).alias("end_sec"),
        F.col("phone").isNull().alias("all_silent"),
    )
    if features:
        samples = joins.complete_features(samples, features, keys[0])
    return samples.withColumn("_sample", sample).join(manifest, "_sample").drop("_sample")


#: Columns of the target manifest as it is written.
TTS_COLUMNS = ("id", "audio", "n_frames", "tgt_text", "speaker", "src_text", "duration")


def write_tts_corpus(manifest: DataFrame, folder: str) -> None:
    """The target side on disk: one manifest per split, the phone vocabulary and the speaker list.

    ``manifest`` is that of :func:`tts_manifest` with id, audio, speaker, src_text and split. Silent
    samples are not written. Pitch and energy stay in the table; a manifest names their locations.
    """
    spoken = manifest.filter(~F.col("all_silent"))
    columns = [c for c in (*TTS_COLUMNS, "pitch_location", "energy_location") if c in manifest.columns]
    write_manifest(spoken, f"{folder}/manifest", columns)
    write_vocab(token_vocab(spoken, F.split("tgt_text", " ")), f"{folder}/vocab")
    write_speakers(spoken, f"{folder}/speakers")


def s2s_manifest(
    transcripts: DataFrame, translations: DataFrame, target: DataFrame, registry: DataFrame, split: str
) -> DataFrame:
    """Manifest of one split: translated clips that have target speech, with features filled in."""
    clips = select_split(joins.join_translations(transcripts, translations), split)
    spoken = joins.override_target(clips, target)
    named = spoken.withColumn("id", normalize_id(F.col("path"))).withColumn("tgt_audio", F.lit(None).cast("string"))
    return joins.fill_manifest(named, registry, "s2s").drop("path")


def score_predictions(
    paths: DataFrame,
    transcripts: DataFrame,
    references: DataFrame,
    language: str = "en",
    mode: str = "collapse",
    silence: str = "|",
) -> DataFrame:
    """BLEU of the recognised predictions (path, tokens) against the reference lines (idx, text).

    A prediction without a transcript scores as the empty string. A bad listing and unequal sides
    fail the job; ``prediction_problems`` and ``unpaired_positions`` name the culprits.
    """
    # Lines are shuffled, and not the tokens they are made of.
    said = transcripts.select("path", asr_postprocess(F.col("tokens"), mode, silence).alias("prediction"))
    heard = list_predictions(paths).join(said, "path", "left").select("idx", F.coalesce("prediction", F.lit("")).alias("prediction"))
    if language == "hok":
        heard = heard.withColumn("prediction", merge_syllables(F.col("prediction")))
    lines = references.select("idx", normalize_line(F.col("text")).alias("reference"))
    # A full outer join always shuffles, here by an index of its own for each pair.
    return bleu.corpus_bleu(joins.paired_by_position(heard, lines), laid=True)


@dataclass(frozen=True)
class Modality:
    """How one kind of sample is batched."""

    max_tokens: int
    max_rows: int | None = None
    ratio: float = 1.0


def training_batches(
    sets: Mapping[str, DataFrame],
    plan: Mapping[str, Modality],
    n_shards: int,
    limits: Mapping[str, tuple[int, int]] = POSITION_LIMITS,
    width: int = batching.BUCKET_WIDTH,
    seed: int = 1,
    epoch: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(batches, rejected) of an epoch: samples of every modality with their batch and ``shard``.

    Each set has (id, source_len, target_len). Batches stay within a modality and its budget. The
    epoch is planned once; a worker reads the rows of its shard.
    """
    parts, rejected = [], []
    for name, df in sets.items():
        mixed, long = mixing.mix_modalities(
            {name: df}, {name: plan[name].ratio}, lengths=("source_len", "target_len"), limits=limits, seed=seed, epoch=epoch
        )
        mixed = mixed.withColumn("sample", F.concat_ws("#", F.col("id").cast("string"), F.col("copy").cast("string")))
        parts.append(
            batching.token_batches(mixed, "source_len", "sample", plan[name].max_tokens, plan[name].max_rows, width=width)
        )
        rejected.append(long)
    number = batching.batch_number(("modality", *batching.BATCH_KEY))
    return stack_rows(*parts).withColumn("shard", F.pmod(number, F.lit(n_shards))), stack_rows(*rejected)
