"""Forced-alignment intervals: durations, silence trimming, offsets, frames per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.numeric import interval_frames
from corpusflow.operators.sequences import Sequences, spans_before, whole_sequence
from corpusflow.operators.unions import stack_rows

# Phones the aligner writes for silence.
SILENCE_PHONES = ("sil", "sp", "spn")

# Contract of the per-phone averages and energies: values are floored here before the logarithm.
LOG_FLOOR = 1e-5


def frame_durations(
    intervals: Sequences, rate: float, hop: int, start: str = "start", end: str = "end", name: str = "duration"
) -> Sequences:
    """Intervals in seconds get whole frames; those shorter than one frame after rounding go."""
    frames = interval_frames(F.col(start), F.col(end), rate, hop)
    return intervals.with_columns({name: frames}).filter(F.col(name) > 0)


def trim_silence(
    intervals: Sequences,
    phone: str = "phone",
    start: str = "start",
    end: str = "end",
    silence: tuple[str, ...] = SILENCE_PHONES,
    position: str = "pos",
) -> Sequences:
    """Drop silence before the first and after the last spoken phone; silence between stays.

    The rows left are renumbered in ``position`` and carry the sample's ``start_sec``/``end_sec``.
    """
    at = F.col(intervals.t)
    spoken = ~F.col(phone).isin(*silence)
    if intervals.one_row:
        counted, before = intervals.running_sum(F.lit(1), "_rank"), F.lit(0)
        ends = counted.attach(
            _first=("min", F.when(spoken, at)),
            _last=("max", F.when(spoken, at)),
            _least=("min", F.when(spoken, F.col("_rank"))),
            start_sec=("min", F.when(spoken, F.col(start))),
            end_sec=("max", F.when(spoken, F.col(end))),
        )
    else:
        # A tier is in time order, so the ends of the spoken stretch are a minimum and a maximum too.
        rank = F.row_number().over(intervals.local())
        whole, before = whole_sequence(), F.col("_before")
        ends = intervals.step(
            [{"_rank": rank.cast("bigint")}],
            {
                "_n": F.count(F.lit(1)),
                "_first": F.min(F.when(spoken, at)),
                "_last": F.max(F.when(spoken, at)),
                "_least": F.min(F.when(spoken, F.col("_rank"))),
                "start_sec": F.min(F.when(spoken, F.col(start))),
                "end_sec": F.max(F.when(spoken, F.col(end))),
            },
            [
                {"_before": F.coalesce(F.sum("_n").over(spans_before()), F.lit(0))},
                {"_least": F.min(F.col("_before") + F.col("_least")).over(whole)},
                {"_first": F.min("_first").over(whole), "_last": F.max("_last").over(whole)},
                {"start_sec": F.min("start_sec").over(whole), "end_sec": F.max("end_sec").over(whole)},
            ],
        )
    kept = ends.filter(at.between(F.col("_first"), F.col("_last")))
    place = (before + F.col("_rank") - F.col("_least")).cast("bigint")
    numbered = kept.with_columns({position: place}).drop("_first", "_last", "_rank", "_least", "_before")
    return numbered.with_df(numbered.raw, t=position)


def trimmed_samples(samples: DataFrame, trimmed: Sequences, duration: str = "duration") -> DataFrame:
    """One row per sample: tokens left, frames, seconds; an all-silent sample reports zeros and a flag."""
    key = F.struct(*trimmed.keys).alias("_sample")
    stats = trimmed.df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(duration).alias("n_frames"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
    )
    joined = samples.select(key).distinct().join(stats, "_sample", "left")
    joined = joined.select("_sample.*", *stats.columns[1:])
    zero = {"n_tokens": 0, "n_frames": 0, "start_sec": 0.0, "end_sec": 0.0}
    return joined.withColumn("all_silent", F.col("n_tokens").isNull()).fillna(zero)


def offsets(durations: Sequences, duration: str = "duration") -> Sequences:
    """First frame and end frame (exclusive) of each token."""
    summed = durations.running_sum(F.col(duration).cast("bigint"), "end_frame")
    return summed.with_columns({"start_frame": F.col("end_frame") - F.col(duration)})


def _covered(frames: Sequences, segments: DataFrame, seg: str) -> Sequences:
    """Frames (``_frame`` true) and segments (false) in one sequence; ``frames.one_row`` speaks for both.

    ``_covering`` is the segment last opened before a frame; a segment row names itself there. A
    segment without frames opens nothing.
    """
    opened = F.struct(F.col(seg).alias("seg"), F.col("end_frame").cast("bigint").alias("end"))
    marks = segments.select(
        *frames.keys,
        F.col("start_frame").cast("bigint").alias(frames.t),
        F.lit(False).alias("_frame"),
        F.when(F.col("end_frame") > F.col("start_frame"), opened).alias("_opens"),
        opened.alias("_own"),
    )
    laid = stack_rows(frames.df.withColumn("_frame", F.lit(True)), marks)
    seen = frames.with_df(laid, ties=("_frame",)).last_seen(F.col("_opens"), "_covering")
    return seen.with_columns({"_covering": F.when(F.col("_frame"), F.col("_covering")).otherwise(F.col("_own"))})


def frames_to_segments(frames: Sequences, segments: DataFrame, seg: str = "seg") -> DataFrame:
    """Give each frame the segment ``[start_frame, end_frame)`` that covers it; others are dropped.

    Segments of a key do not overlap. They are laid into the frame sequence at their first frame
    and the latest one is carried forward: one shuffle, whatever the segment lengths, and no row
    per covered frame.
    """
    payload = [c for c in frames.df.columns if c not in (*frames.keys, frames.t)]
    inside = F.col("_frame") & (F.col(frames.t) < F.col("_covering.end"))
    rows = _covered(frames, segments, seg).df.filter(inside)
    return rows.select(*frames.keys, frames.t, F.col("_covering.seg").alias(seg), *payload)


def segment_mean(
    frames: Sequences,
    segments: DataFrame,
    value: str,
    seg: str = "seg",
    log_scale: bool = False,
    log_mean: str | None = None,
) -> DataFrame:
    """Mean of ``value`` over each segment's frames; a segment without frames gets 0.

    The segments travel with the frames, so those without frames need no join to show up. ``log_mean``
    names a column for the mean in log beside the plain one, from the same pass.
    """
    logged = F.ln(F.greatest(F.col(value), F.lit(LOG_FLOOR)))
    slim = frames.with_df(frames.df.select(*frames.keys, frames.t, value))
    rows = _covered(slim, segments, seg).df.filter(
        ~F.col("_frame") | (F.col(frames.t) < F.col("_covering.end"))
    )
    measured = F.col("_frame") & F.col(value).isNotNull()
    mean = lambda taken, name: F.coalesce(F.avg(F.when(measured, taken)), F.lit(0.0)).alias(name)
    return rows.groupBy(*frames.keys, F.col("_covering.seg").alias(seg)).agg(
        mean(logged if log_scale else F.col(value), "mean"),
        *([mean(logged, log_mean)] if log_mean else []),
        F.count(F.when(measured, 1)).alias("n_frames"),
    )


def frame_log_energy(
    series: Sequences, value: Column, length: int, hop: int, complete_only: bool = True
) -> DataFrame:
    """Log energy of overlapping frames of ``length`` samples every ``hop`` samples.

    Each sample goes to the few frames that cover it; sums are partial before the shuffle.
    """
    t = F.col(series.t)
    last = F.floor(t / hop).cast("bigint")
    first = F.greatest(F.ceil((t - (length - 1)) / hop).cast("bigint"), F.lit(0).cast("bigint"))
    covering = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spread = series.df.select(*series.keys, F.explode(covering).alias("frame"), value.alias("_v"))
    frames = spread.groupBy(*series.keys, "frame").agg(
        F.sum(F.col("_v") * F.col("_v")).alias("_energy"), F.count(F.lit(1)).alias("_n")
    )
    if complete_only:
        frames = frames.filter(F.col("_n") == length)
    return frames.select(*series.keys, "frame", F.ln(F.greatest(F.col("_energy"), F.lit(LOG_FLOOR))).alias("log_energy"))
