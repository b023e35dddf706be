"""Scalar formulas on frames, durations and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def interval_frames(start: Column, end: Column, rate: float, hop: int) -> Column:
    """Frames between two times in seconds; both ends round half to even, as numpy does."""
    per_second = F.lit(rate / hop)
    return (F.rint(end * per_second) - F.rint(start * per_second)).cast("bigint")


def bucketize(value: Column, lo: float, hi: float, n_bins: int = 256) -> Column:
    """Number of the ``n_bins - 1`` evenly spaced edges from lo to hi that lie below the value."""
    if n_bins < 3 or hi <= lo:
        raise ValueError("bucketize needs hi > lo and at least 3 bins")
    step = (hi - lo) / (n_bins - 2)
    below = F.ceil((value - F.lit(lo)) / F.lit(step))
    return F.when(value <= lo, 0).when(value > hi, n_bins - 1).otherwise(below).cast("bigint")


def log_duration(frames: Column) -> Column:
    return F.log1p(frames.cast("double"))


def duration_frames(log_value: Column, factor: float = 1.0, is_pad: Column | None = None) -> Column:
    """Undo :func:`log_duration`: whole frames, never negative, 0 at padding."""
    frames = F.greatest(F.rint(F.expm1(log_value) * F.lit(factor)), F.lit(0.0)).cast("bigint")
    return frames if is_pad is None else F.when(is_pad, F.lit(0).cast("bigint")).otherwise(frames)


def hypothesis_score(
    log_prob: Column,
    length: Column,
    len_penalty: float = 1.0,
    n_unknown: Column | None = None,
    unk_penalty: float = 0.0,
    lm_score: Column | None = None,
    lm_weight: float = 0.0,
) -> Column:
    """Total log-probability over length ** penalty; the length counts the end symbol; NaN is -inf."""
    total = log_prob.cast("double")
    if lm_score is not None:
        total = total + lm_score * F.lit(lm_weight)
    if n_unknown is not None:
        total = total - n_unknown * F.lit(unk_penalty)
    total = F.when(F.isnan(total), F.lit(float("-inf"))).otherwise(total)
    return total / F.pow(length.cast("double"), F.lit(float(len_penalty)))
