"""Ordered sequences in long form: one row per (key, position).

A sequence may be far larger than a task (one key can hold a third of a table), so nothing here
relies on all rows of a key meeting in one place, at any size. A sequence is cut into spans that
follow its order; windows run inside (key, span), each span is reduced to one row, and what a span
needs from the spans before it is worked out on those rows and joined back on (key, span). Key and
span stay with the rows as hidden columns, so a chain of steps shuffles its full rows once. A key is
compared as a struct, where nulls are equal: rows with a null key are a sequence like others.

Only a sequence exploded from the arrays of one row (``one_row``) takes plain windows: it fitted a
row before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.session import written

SPAN = 1 << 16
#: Bytes of a range of the layout, and the most ranges there are (estimates of joined tables can be far too high).
RANGE_BYTES, MOST_RANGES = 128 << 20, 100_000
_KEY, _SPAN, _LOCAL, _CARRY = "_key", "_span", "_local", "_carry"


def span_order():
    """The spans of a sequence in order."""
    return Window.partitionBy(_KEY).orderBy(_SPAN)


def spans_before():
    """The spans before each one."""
    return span_order().rowsBetween(Window.unboundedPreceding, -1)


def whole_sequence():
    """All spans of a sequence."""
    return Window.partitionBy(_KEY)


def _key_of(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.lit(0)


@dataclass(frozen=True)
class Sequences:
    """Rows of ``raw`` are ordered by ``t`` (a bigint), then ``ties``, within ``keys``.

    ``raw`` may hold the hidden key and span; ``df`` is the table without them. ``one_row`` states
    that each sequence came out of one row.
    """

    raw: DataFrame
    keys: tuple[str, ...]
    t: str = "t"
    one_row: bool = False
    span: int = SPAN
    ties: tuple[str, ...] = ()

    @property
    def df(self) -> DataFrame:
        return self.raw.drop(_KEY, _SPAN)

    def with_df(self, df: DataFrame, **changes) -> Sequences:
        return replace(self, raw=df, **changes)

    def filter(self, condition: Column) -> Sequences:
        return self.with_df(self.raw.filter(condition))

    def with_columns(self, columns: dict[str, Column]) -> Sequences:
        return self.with_df(self.raw.withColumns(columns))

    def drop(self, *columns: str) -> Sequences:
        return self.with_df(self.raw.drop(*columns))

    def select(self, *columns: str | Column) -> Sequences:
        """Keys, position and these columns; rows stay where they lie."""
        hidden = [c for c in (_KEY, _SPAN) if c in self.raw.columns]
        return self.with_df(self.raw.select(*hidden, *self.keys, self.t, *columns))

    @property
    def _order(self) -> list[str]:
        return [self.t, *self.ties]

    def _spanned(self) -> DataFrame:
        if self.one_row or _SPAN in self.raw.columns:
            return self.raw
        span = F.floor(F.col(self.t) / F.lit(self.span)).cast("bigint")
        return self.raw.withColumns({_KEY: _key_of(self.keys), _SPAN: span})

    @property
    def _groups(self) -> list[str]:
        return [*self.keys] if self.one_row else [_KEY, _SPAN]

    def local(self):
        """The window over a row's span, or its whole sequence where that came out of one row."""
        return Window.partitionBy(*self._groups).orderBy(*self._order)

    def step(self, local: Sequence[dict[str, Column]], summary: dict[str, Column], carry: Sequence[dict[str, Column]]) -> Sequences:
        """One pass over the rows: columns of each row by windows inside its span, one summary row for each
        span, and what the spans of a sequence tell each other joined back.

        ``local`` and ``carry`` are evaluated in turn, so later ones see the earlier; ``carry`` sees
        the summaries and may use :func:`span_order` windows. Full rows are shuffled once, and not again by
        a further step.
        """
        df = self._spanned()
        for columns in local:
            df = df.withColumns(columns)
        spans = df.groupBy(_KEY, _SPAN).agg(*[column.alias(name) for name, column in summary.items()])
        for columns in carry:
            spans = spans.withColumns(columns)
        wanted = dict.fromkeys(name for columns in carry for name in columns)
        return self.with_df(df.join(spans.select(_KEY, _SPAN, *wanted), [_KEY, _SPAN]))

    def running_sum(self, value: Column, name: str) -> Sequences:
        """Sum of ``value`` up to and including each row."""
        window = self.local().rowsBetween(Window.unboundedPreceding, 0)
        if self.one_row:
            return self.with_columns({name: F.sum(value).over(window)})
        local = [{"_value": value}, {_LOCAL: F.sum("_value").over(window)}]
        stepped = self.step(local, {"_sum": F.sum("_value")}, [{_CARRY: F.coalesce(F.sum("_sum").over(spans_before()), F.lit(0))}])
        return stepped.with_columns({name: F.col(_LOCAL) + F.col(_CARRY)}).drop(_LOCAL, _CARRY, "_value")

    def previous(self, value: Column, name: str, default: Column | None = None) -> Sequences:
        """``value`` of the row before, ``default`` (or null) at the start of a sequence."""
        default = F.lit(None) if default is None else default
        local = [{"_boxed": F.struct(value.alias("v"))}, {_LOCAL: F.lag("_boxed").over(self.local())}]
        if self.one_row:
            stepped, before = self.with_columns(local[0]).with_columns(local[1]), F.col(_LOCAL)
        else:
            last = {"_last": F.max_by("_boxed", F.struct(*self._order))}
            stepped, before = self.step(local, last, [{_CARRY: F.lag("_last").over(span_order())}]), F.coalesce(_LOCAL, _CARRY)
        result = F.when(before.isNull(), default).otherwise(before["v"])
        return stepped.with_columns({name: result}).drop(_LOCAL, _CARRY, "_boxed")

    def last_seen(self, value: Column, name: str) -> Sequences:
        """The latest non-null ``value`` up to and including each row."""
        window = self.local().rowsBetween(Window.unboundedPreceding, 0)
        if self.one_row:
            return self.with_columns({name: F.last(value, ignorenulls=True).over(window)})
        local = [{"_value": value}, {_LOCAL: F.last("_value", ignorenulls=True).over(window)}]
        latest = {"_last": F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*self._order)))}
        stepped = self.step(local, latest, [{_CARRY: F.last("_last", ignorenulls=True).over(spans_before())}])
        return stepped.with_columns({name: F.coalesce(_LOCAL, _CARRY)}).drop(_LOCAL, _CARRY, "_value")

    def attach(self, **stats: tuple[str, Column]) -> Sequences:
        """Give every row facts about its whole sequence: ``name=("min" | "max" | "sum", column)``."""
        fold = {"min": F.min, "max": F.max, "sum": F.sum}
        if self.one_row:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({name: fold[how](col).over(whole) for name, (how, col) in stats.items()})
        whole = whole_sequence()
        return self.step(
            [], {name: fold[how](col) for name, (how, col) in stats.items()}, [{name: fold[how](name).over(whole) for name, (how, _) in stats.items()}]
        )

    def lengths(self, name: str = "n") -> DataFrame:
        """Rows per sequence (partial counts are made before the shuffle)."""
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(name))

    def arrays(self, *columns: str) -> DataFrame:
        """One row per sequence: its columns as ordered arrays. For sequences that are a row by nature."""
        packed = self.df.groupBy(*self.keys).agg(
            F.array_sort(F.collect_list(F.struct(*self._order, *columns))).alias("_rows")
        )
        return packed.select(*self.keys, *[F.col("_rows")[c].alias(c) for c in columns])

    def longer_than(self, limit: int) -> DataFrame:
        return self.lengths().filter(F.col("n") > limit)


def exploded(
    df: DataFrame, keys: Sequence[str], t: str = "t", n: str | None = None, **arrays: Column
) -> Sequences:
    """Sequences from array columns of one row each.

    ``n`` names a column for the length. Lay ``df`` out by ``keys`` first if windows follow: then
    whole rows are shuffled instead of their elements.
    """
    lists = F.arrays_zip(*[col.alias(name) for name, col in arrays.items()])
    packed = df.select(*keys, lists.alias("_lists"))
    size = [F.size("_lists").cast("bigint").alias(n)] if n else []
    rows = packed.select(*keys, *size, F.posexplode("_lists").alias(t, "_item"))
    rows = rows.select(
        *keys, *([n] if n else []), F.col(t).cast("bigint").alias(t), *[F.col("_item")[name].alias(name) for name in arrays]
    )
    return Sequences(rows, tuple(keys), t, one_row=True)


def from_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], t: str = "t") -> Sequences:
    """Sequences from rows that carry an order (unique within the key) but no position.

    The table is range-partitioned on (keys, order), so a hot key spreads over as many partitions as
    it needs. The range bounds are sampled, so the layout is written to the shared folder before it is read. Its parts
    are the spans: a row's number inside its part is written with it, and what turns that into a position is
    one row for each part and key, joined when the sequence is used.
    """
    by_key = [F.col(k).asc() for k in keys]
    ranges = _ranges(df)
    laid = df.repartitionByRange(*([ranges] if ranges else []), *by_key, *order).sortWithinPartitions(*by_key, *order)
    laid = written(laid.withColumn("_row", F.monotonically_increasing_id()), "laid-out")
    laid = laid.withColumns({_KEY: _key_of(keys), _SPAN: F.shiftright("_row", 33)})
    pieces = laid.groupBy(_KEY, _SPAN).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # At most one row per partition and key.
    shift = F.coalesce(F.sum("_n").over(spans_before()), F.lit(0)) - F.col("_first")
    numbered = laid.join(pieces.select(_KEY, _SPAN, shift.alias("_shift")), [_KEY, _SPAN])
    numbered = numbered.withColumn(t, F.col("_row") + F.col("_shift")).drop("_row", "_shift")
    return Sequences(numbered, tuple(keys), t)


def _ranges(df: DataFrame) -> int | None:
    """How many ranges a table wants by the planner's estimate of its size; None leaves a small one to the session."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(estimate // RANGE_BYTES, MOST_RANGES)
    return wanted if wanted > usual else None


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "t") -> DataFrame:
    """Number the rows of each key 0, 1, ... in ``order`` (which must be unique within the key).

    ``keys`` may be empty: then the whole table is one sequence.
    """
    return from_rows(df, keys, order, name).df
