"""Operations on the short arrays one sample carries (phones, durations, feature vectors)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_durations(col: Column) -> Column:
    """``"3 5 2"`` to ``[3, 5, 2]``; an unreadable field makes the whole value null."""
    fields = F.transform(F.split(col, " "), lambda d: d.try_cast("int"))
    return F.when(F.forall(fields, lambda d: d.isNotNull()), fields)


def format_durations(durations: Column) -> Column:
    return F.array_join(F.transform(durations, lambda d: d.cast("string")), " ")


def array_sum(values: Column, as_type: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(as_type), lambda acc, v: acc + v.cast(as_type))


def target_length(durations: Column) -> Column:
    """Frames of a sample."""
    return array_sum(durations)


def eos_pad(values: Column, zero=0) -> Column:
    """One more zero for the end symbol."""
    return F.concat(values, F.array(F.lit(zero)))


def adjacent_repeats(tokens: Column) -> Column:
    """How often a token equals the one before it; 0 for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    same = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: a == b)
    return F.size(F.filter(same, lambda s: s))


def ctc_required_length(tokens: Column, n_positions: Column, ratio: int) -> Column:
    """Frames a target needs: every token, a blank between repeats, and no fewer than n * ratio."""
    needed = F.size(tokens) + adjacent_repeats(tokens)
    return F.greatest(n_positions * F.lit(ratio), needed).cast("bigint")


def crop(samples: Column, start_sec: Column, end_sec: Column, rate: float) -> Column:
    """``samples[int(start * rate) : int(end * rate)]``."""
    start = F.least((start_sec * rate).cast("int"), F.size(samples))
    end = F.least((end_sec * rate).cast("int"), F.size(samples))
    return F.slice(samples, start + 1, F.greatest(end - start, F.lit(0)))


def unpad(frames: Column, length: Column, zero_frame: Column) -> Column:
    """Cut to the true length; length 0 gives one zero frame."""
    return F.when(length > 0, F.slice(frames, F.lit(1), length)).otherwise(F.array(zero_frame))


def stack_frames(frames: Column, n: int) -> Column:
    """Put n frames side by side and drop the remainder; scalars become frames of n values."""
    count = F.floor(F.size(frames) / n).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(frames, i * n + 1, n))


def pack_frames(frames: Column, n: int) -> Column:
    """:func:`stack_frames` for frames that are vectors: each packed frame is one long vector."""
    return frames if n == 1 else F.transform(stack_frames(frames, n), F.flatten)


def transpose(matrix: Column) -> Column:
    """frames x dims to dims x frames."""
    dims = F.size(F.get(matrix, F.lit(0)))
    index = F.when(dims > 0, F.sequence(F.lit(0), dims - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda d: F.transform(matrix, lambda frame: F.get(frame, d)))


def stretch(values: Column, ratio: int) -> Column:
    """Every value ``ratio`` times in a row (uniform upsampling by a whole factor)."""
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, ratio)))


def shift_right_tokens(tokens: Column, eos) -> Column:
    """Previous-step input: the end symbol first, a trailing one cut."""
    eos = F.lit(eos)
    n = F.size(tokens)
    body = F.when(F.element_at(tokens, -1) == eos, F.slice(tokens, F.lit(1), n - 1)).otherwise(tokens)
    return F.when(n > 0, F.concat(F.array(eos), body)).otherwise(F.array(eos))


def pad_to(values: Column, width: Column, pad) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def absolute_distance(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda acc, v: acc + v
    )


def smooth_l1_distance(x: Column, y: Column) -> Column:
    """0.5 d^2 below 1, |d| - 0.5 beyond, summed."""

    def term(a: Column, b: Column) -> Column:
        d = F.abs(a.cast("double") - b.cast("double"))
        return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)

    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda acc, v: acc + v)


def cosine(x: Column, y: Column) -> Column:
    """Each norm is kept above 1e-8, so zero vectors score 0."""
    floor = F.lit(1e-8)
    return dot(x, y) / (F.greatest(F.sqrt(dot(x, x)), floor) * F.greatest(F.sqrt(dot(y, y)), floor))
