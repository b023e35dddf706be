"""Greedy label collapse and merging of the frames behind each label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.operators.sequences import Sequences, span_order, spans_before

# Fixed values of the model's symbol table.
BLANK_ID, PAD_ID = 0, 1

MERGE_KINDS = ("softmax", "meanpool", "maxpool", "weighted")


def _numbered_runs(frames: Sequences, symbol: str, blank) -> Sequences:
    """Frames with ``_opens`` (starts a label run) and ``_runs`` (runs opened so far)."""
    sym = F.col(symbol)

    def opens(now: Column, before: Column) -> Column:
        """Whether a label run opens at ``now``; ``before`` is the symbol ahead of it, boxed, null at the start."""
        fresh = F.coalesce(before["v"] != now, F.lit(True))
        return F.coalesce(now != F.lit(blank), F.lit(False)) & (before.isNull() | fresh)

    order = F.struct(frames.t, *frames.ties)
    window = frames.local()
    boxed = F.struct(sym.alias("v"))
    local = [
        {"_boxed": boxed},
        {"_prev": F.lag("_boxed").over(window)},
        # The first row of a span is settled when the span before it is known.
        {"_opens": F.when(F.col("_prev").isNotNull() | F.lit(frames.one_row), opens(sym, F.col("_prev")))},
        {"_runs": F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))},
    ]
    if frames.one_row:
        for columns in local:
            frames = frames.with_columns(columns)
        return frames.drop("_boxed", "_prev")
    summary = {
        "_first": F.min_by("_boxed", order),
        "_last": F.max_by("_boxed", order),
        "_n": F.sum(F.when(F.col("_opens"), 1).otherwise(0)),
    }
    carry = [
        {"_head": opens(F.col("_first.v"), F.lag("_last").over(span_order()))},
        {"_carry": F.coalesce(F.sum(F.col("_n") + F.col("_head").cast("int")).over(spans_before()), F.lit(0)) + F.col("_head").cast("int")},
    ]
    stepped = frames.step(local, summary, carry)
    settled = {"_opens": F.coalesce("_opens", "_head"), "_runs": F.col("_runs") + F.col("_carry")}
    return stepped.with_columns(settled).drop("_boxed", "_prev", "_head", "_carry")


def ctc_index(frames: Sequences, symbol: str = "symbol", blank=BLANK_ID, name: str = "run") -> Sequences:
    """1-based number of the label run each frame belongs to, 0 for blank frames."""
    counted = _numbered_runs(frames, symbol, blank)
    run = F.when(F.col(symbol) != F.lit(blank), F.col("_runs")).otherwise(0).cast("bigint")
    return counted.with_columns({name: run}).drop("_opens", "_runs")


def ctc_collapse(frames: Sequences, symbol: str = "symbol", blank=BLANK_ID) -> Sequences:
    """Merge runs and drop blanks: one row per label, ``pos`` from 0, with its first frame.

    The frames that open a run are the answer, so nothing is grouped. Long form on purpose: a
    sequence may have more labels than one row can hold.
    """
    opening = _numbered_runs(frames, symbol, blank).df.filter(F.col("_opens"))
    labels = opening.select(
        *frames.keys, (F.col("_runs") - 1).cast("bigint").alias("pos"), symbol, F.col(frames.t).alias("start_frame")
    )
    return Sequences(labels, frames.keys, "pos", frames.one_row, frames.span)


def ctc_lengths(frames: Sequences, symbol: str = "symbol", blank=BLANK_ID) -> DataFrame:
    """Number of labels per sequence, 0 for an all-blank one."""
    return ctc_index(frames, symbol, blank).df.groupBy(*frames.keys).agg(F.max("run").alias("n_labels"))


def _merged(value: Column, prob: Column | None, how: str) -> Column:
    if how == "softmax":
        # Probabilities lie in [0, 1], so the exponentials need no shift.
        return F.sum(F.exp(prob) * value) / F.sum(F.exp(prob))
    if how == "meanpool":
        return F.avg(value)
    if how == "maxpool":
        return F.max(value)
    if how == "weighted":
        return F.avg(value * prob)
    raise ValueError(f"merge kind {how!r} is none of {MERGE_KINDS}")


def ctc_merge(
    frames: Sequences,
    how: str,
    value: Column,
    prob: Column | None = None,
    symbol: str = "symbol",
    blank=BLANK_ID,
    vector: bool = False,
) -> DataFrame:
    """One value (or vector, as rows of ``dim``) per label run; blank frames are left out.

    Only sums, averages and maxima per (key, run): partial aggregation takes the weight off long
    runs before the shuffle.
    """
    if how in ("softmax", "weighted") and prob is None:
        raise ValueError(f"{how} needs the frame probabilities")
    prepared = frames.with_columns({"_p": F.lit(1.0) if prob is None else prob, "_v": value})
    rows = ctc_index(prepared, symbol, blank).df.filter(F.col("run") > 0)
    groups = [*frames.keys, "run"]
    if vector:
        rows = rows.select(*groups, "_p", F.posexplode("_v").alias("dim", "_v"))
        groups.append("dim")
    return rows.groupBy(*groups).agg(_merged(F.col("_v").cast("double"), F.col("_p"), how).alias("value"))


def uniform_upsample(
    sequences: Sequences, length: Column | None = None, ratio: int | None = None, n: str | None = None
) -> Sequences:
    """Stretch n positions to m: output t takes source position ``t * n div m``.

    Every source row knows the stretch of outputs it feeds, so there is no join. Give a whole
    ``ratio``, or ``length`` = m as a column that is constant within a sequence. ``n`` names a
    column that holds n; without it the rows are counted.
    """
    t = sequences.t
    if ratio is not None:
        seen, first, last = sequences, F.col(t) * ratio, (F.col(t) + 1) * ratio - 1
    else:
        seen = sequences.with_columns({"_m": length})
        seen = seen.attach(_n=("sum", F.lit(1))) if n is None else seen.with_columns({"_n": F.col(n)})
        first = F.ceil(F.col(t) * F.col("_m") / F.col("_n"))
        last = F.ceil((F.col(t) + 1) * F.col("_m") / F.col("_n")) - 1
    first, last = first.cast("bigint"), last.cast("bigint")
    outputs = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    df = seen.df.withColumn("_out", F.explode(outputs)).withColumn("src", F.col(t)).withColumn(t, F.col("_out"))
    return sequences.with_df(df.drop("_out", "_m", "_n"), one_row=False)


def length_regulate(tokens: Sequences, duration: str = "duration", frame: str = "frame") -> Sequences:
    """Repeat each token for its frames; the frame number comes from the running sum."""
    summed = tokens.running_sum(F.col(duration).cast("bigint"), "_end")
    start = F.col("_end") - F.col(duration)
    frames = F.when(F.col(duration) > 0, F.sequence(start, F.col("_end") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    df = summed.df.withColumn(frame, F.explode(frames)).drop("_end")
    return tokens.with_df(df, t=frame, one_row=False)


def shift_right(frames: Sequences, value: str, name: str = "prev", zero: Column | None = None) -> Sequences:
    """Previous-step input: the zero frame first, then all frames but the last."""
    return frames.previous(F.col(value), name, F.lit(0.0) if zero is None else zero)


def unpad(frames: Sequences, length: Column, value: str | None = None, zero: Column | None = None) -> Sequences:
    """Cut a padded sequence in long form to its true length; with ``value``, length 0 gives one zero frame.

    ``length`` is constant within a sequence. The zero frame is the first of the padded ones, its ``value`` 0 (or ``zero``); without
    ``value`` a sequence of length 0 has no frame left.
    """
    inside, at = F.col(frames.t) < length, F.col(frames.t)
    if value is None:
        return frames.filter(inside)
    zero = F.lit(0.0) if zero is None else zero
    return frames.with_columns({"_inside": inside}).filter(F.col("_inside") | ((length <= 0) & (at == 0))).with_columns(
        {value: F.when(F.col("_inside"), F.col(value)).otherwise(zero)}
    ).drop("_inside")


def pack_long_frames(frames: Sequences, value: str, n: int, frame: str = "frame") -> DataFrame:
    """Stack n frames into one and drop the remainder, for frames in long form."""
    grouped = frames.df.groupBy(*frames.keys, F.floor(F.col(frames.t) / n).cast("bigint").alias(frame)).agg(
        F.array_sort(F.collect_list(F.struct(frames.t, value)))[value].alias(value)
    )
    return grouped.filter(F.size(value) == n)
