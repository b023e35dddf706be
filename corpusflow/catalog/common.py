"""Bindings shared by several queries, on the Spark side and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.catalog import Tables
from corpusflow.functions.text import words
from corpusflow.operators.sequences import Sequences, exploded, from_rows

# White space as SQL engines with RE2 spell it, and the scorer's symbol rules in their own ranges.
SPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SQL_13A_RULES = (
    (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def r6(col: Column, name: str) -> Column:
    return F.round(col.cast("double"), 6).alias(name)


def joined(col: Column) -> Column:
    """An array as text, for comparison."""
    return F.array_join(F.transform(col, lambda v: v.cast("string")), " ")


def one_line(col: Column) -> Column:
    """The whole text on one line, as line-based formats need it."""
    return F.regexp_replace(col, r"[\t\n\r]+", " ")


def split_of(key: Column) -> Column:
    """train, train_covost, dev or test, by key."""
    digit = F.pmod(key, F.lit(10))
    return F.when(digit < 6, "train").when(digit < 7, "train_covost").when(digit < 8, "dev").otherwise("test")


def user_frames(t: Tables) -> Sequences:
    """Events of a user in time order: position, symbol, value, and the seconds since the event before. Laid out once a query."""
    if "user_frames" in t.shared:
        return t.shared["user_frames"]
    events = t.events.select(
        "user_id",
        "event_id",
        "ts",
        F.col("event_type").alias("symbol"),
        "value",
        (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / 1e6).alias("sec"),
    )
    t.shared["user_frames"] = from_rows(events, ["user_id"], [F.col("ts"), F.col("event_id")])
    return t.shared["user_frames"]


def user_intervals(t: Tables) -> Sequences:
    """The gap before each event as an alignment interval named after the event."""
    timed = user_frames(t).previous(F.col("sec"), "start", F.lit(0.0))
    return timed.select(F.col("symbol").alias("phone"), "start", F.col("sec").alias("end"))


def user_segments(t: Tables) -> tuple[Sequences, DataFrame]:
    """User frames, and segments of 0 to 2 frames in a row whose lengths the events give."""
    from corpusflow.operators.alignment import offsets

    frames = user_frames(t)
    lengths = frames.select(F.pmod("event_id", F.lit(3)).alias("duration"))
    spans = offsets(lengths).df
    return frames, spans.select("user_id", F.col("t").alias("seg"), "start_frame", "end_frame")


def benchmark_words(t: Tables) -> Sequences:
    """Words of the benchmark as phones, with their length as duration."""
    spoken = words(F.col("text"))
    laid = t.benchmark.select("item_id", "text").repartition("item_id")
    return exploded(
        laid, ["item_id"], token=spoken, duration=F.transform(spoken, lambda w: F.length(w))
    )


def even_odd(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The embeddings as two aligned sides: neighbours 2p and 2p + 1 share position p."""
    sided = t.embeddings.select(
        F.floor(F.col("vec_id") / 2).alias("pos"), F.pmod("vec_id", F.lit(2)).alias("side"), "label", F.col("embedding").alias("vec")
    )
    return sided.filter("side = 0").drop("side"), sided.filter("side = 1").drop("side")


# SQL text.


def sql_words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '[{SPACE_CLASS}]+'), lambda w: w <> '')"


def sql_strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def sql_one_line(col: str) -> str:
    return rf"regexp_replace({col}, '[\t\n\r]+', ' ', 'g')"


def sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_split(key: str) -> str:
    return (
        f"CASE WHEN {key} % 10 < 6 THEN 'train' WHEN {key} % 10 < 7 THEN 'train_covost' "
        f"WHEN {key} % 10 < 8 THEN 'dev' ELSE 'test' END"
    )


SQL_FRAMES = """
frames AS (
  SELECT user_id, event_id, event_type AS symbol, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS sec,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t
  FROM events)"""

SQL_INTERVALS = f"""{SQL_FRAMES},
intervals AS (
  SELECT user_id, t, symbol AS phone, coalesce(lag(sec) OVER (PARTITION BY user_id ORDER BY t), 0.0) AS "start",
         sec AS "end"
  FROM frames)"""

SQL_SEGMENTS = f"""{SQL_FRAMES},
segments AS (
  SELECT user_id, t AS seg, end_frame - duration AS start_frame, end_frame FROM (
    SELECT user_id, t, event_id % 3 AS duration,
           sum(event_id % 3) OVER (PARTITION BY user_id ORDER BY t) AS end_frame
    FROM frames))"""

SQL_RUNS = f"""{SQL_FRAMES},
marked AS (
  SELECT *, CASE WHEN symbol <> 'view' AND symbol IS DISTINCT FROM lag(symbol) OVER (PARTITION BY user_id ORDER BY t)
            THEN 1 ELSE 0 END AS opens
  FROM frames),
runs AS (
  SELECT user_id, t, symbol, value, CASE WHEN symbol = 'view' THEN 0
         ELSE sum(opens) OVER (PARTITION BY user_id ORDER BY t) END::BIGINT AS run
  FROM marked)"""

SQL_BENCH_WORDS = f"""
words AS (
  SELECT item_id, i - 1 AS t, w[i] AS token, length(w[i]) AS duration
  FROM (SELECT item_id, {sql_words('text')} AS w FROM benchmark) b, unnest(generate_series(1, len(w))) u(i))"""

SQL_PAIRS = """
pairs AS (
  SELECT a.vec_id // 2 AS pos, a.embedding AS x, b.embedding AS y, a.label AS label
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"""
