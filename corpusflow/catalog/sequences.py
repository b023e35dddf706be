"""Alignment, label collapse and frame-sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.functions import arrays as A
from corpusflow.functions import numeric, text as X
from corpusflow.operators import aggregates, alignment, ctc
from corpusflow.operators.sequences import exploded
from corpusflow.operators.unions import stack_rows

catalog = Catalog()
RATE, HOP = 22_050, 256


@catalog.add(
    f"""WITH {C.SQL_INTERVALS}, d AS (SELECT user_id, t, (round_even("end" * {RATE / HOP}::DOUBLE, 0) - round_even("start" * {RATE / HOP}::DOUBLE, 0))::BIGINT AS duration FROM intervals)
    SELECT * FROM d WHERE duration > 0"""
)
def interval_frame_durations(t: Tables):
    durations = alignment.frame_durations(C.user_intervals(t), RATE, HOP)
    return durations.df.select("user_id", "t", "duration")


SQL_TRIMMED = f"""{C.SQL_INTERVALS},
longer AS (SELECT *, round_even("end" * {RATE / HOP}::DOUBLE, 0) - round_even("start" * {RATE / HOP}::DOUBLE, 0) AS duration FROM intervals),
bounds AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM longer WHERE duration > 0 AND phone NOT IN ('error', 'view') GROUP BY user_id),
kept AS (SELECT l.user_id, l.t, phone, duration::BIGINT AS duration, "start", "end",
    row_number() OVER (PARTITION BY l.user_id ORDER BY l.t) - 1 AS pos
  FROM longer l JOIN bounds b ON l.user_id = b.user_id AND l.t BETWEEN lo AND hi WHERE duration > 0)"""


def trimmed(t: Tables):
    return alignment.trim_silence(
        alignment.frame_durations(C.user_intervals(t), RATE, HOP), silence=("error", "view")
    )


@catalog.add(
    f"""WITH {SQL_TRIMMED} SELECT user_id, pos, phone, duration,
      round(first_value("start") OVER w, 6) AS start_sec, round(last_value("end") OVER w, 6) AS end_sec
    FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def trim_silence(t: Tables):
    return trimmed(t).df.select(
        "user_id", "pos", "phone", "duration", C.r6(F.col("start_sec"), "start_sec"), C.r6(F.col("end_sec"), "end_sec")
    )


@catalog.add(
    f"""WITH {C.SQL_BENCH_WORDS} SELECT item_id, t, (sum(duration) OVER w - duration)::BIGINT AS start_frame, (sum(duration) OVER w)::BIGINT AS end_frame
    FROM words WINDOW w AS (PARTITION BY item_id ORDER BY t)"""
)
def duration_offsets(t: Tables):
    return alignment.offsets(C.benchmark_words(t)).df.select("item_id", "t", "start_frame", "end_frame")


@catalog.add(
    f"""WITH {C.SQL_SEGMENTS}
    SELECT s.user_id, s.seg, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(avg(CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-5)) END), 0), 6) AS log_mean,
      count(value)::BIGINT AS n_frames
    FROM segments s LEFT JOIN frames f ON f.user_id = s.user_id AND f.t >= s.start_frame AND f.t < s.end_frame GROUP BY s.user_id, s.seg"""
)
def segment_mean(t: Tables):
    frames, segments = C.user_segments(t)
    both = alignment.segment_mean(frames, segments, "value", log_mean="log_mean")
    return both.select("user_id", "seg", C.r6(F.col("mean"), "mean"), C.r6(F.col("log_mean"), "log_mean"), "n_frames")


@catalog.add(
    f"""WITH {C.SQL_FRAMES}, cover AS (SELECT user_id, f AS frame, value FROM frames, unnest(generate_series(0, t // 4)) u(f) WHERE t - f * 4 < 8)
    SELECT user_id, frame, round(ln(greatest(sum(value * value), 1e-5)), 6) AS log_energy FROM cover GROUP BY user_id, frame HAVING count(*) = 8"""
)
def frame_log_energy(t: Tables):
    energy = alignment.frame_log_energy(C.user_frames(t), F.col("value"), length=8, hop=4)
    return energy.withColumn("log_energy", F.round("log_energy", 6))


@catalog.add(
    f"""WITH {C.SQL_RUNS} SELECT user_id, run - 1 AS pos, min(symbol) AS symbol, min(t) AS start_frame
    FROM runs WHERE run > 0 GROUP BY user_id, run"""
)
def ctc_collapse(t: Tables):
    return ctc.ctc_collapse(C.user_frames(t), blank="view").df


@catalog.add(f"WITH {C.SQL_RUNS} SELECT user_id, t, run FROM runs")
def ctc_segment_index(t: Tables):
    return ctc.ctc_index(C.user_frames(t), blank="view").df.select("user_id", "t", "run")


MERGE_SQL = {
    "softmax": "sum(exp(1 / (1 + value)) * value) / sum(exp(1 / (1 + value)))",
    "meanpool": "avg(value)",
    "maxpool": "max(value)",
    "weighted": "avg(value * (1 / (1 + value)))",
}


def _merge_query(how: str):
    def merged(t: Tables):
        prob = 1 / (1 + F.col("value"))
        result = ctc.ctc_merge(C.user_frames(t), how, F.col("value"), prob, blank="view")
        return result.withColumn("value", F.round("value", 6))

    return merged


for _how, _expression in MERGE_SQL.items():
    catalog.add(
        f"WITH {C.SQL_RUNS} SELECT user_id, run, round({_expression}, 6) AS value FROM runs WHERE run > 0 GROUP BY user_id, run",
        name=f"ctc_merge_{_how}",
    )(_merge_query(_how))


@catalog.add(
    f"""WITH {C.SQL_BENCH_WORDS}, r AS (SELECT *, CASE WHEN duration = lag(duration) OVER (PARTITION BY item_id ORDER BY t) THEN 1 ELSE 0 END AS rep FROM words)
    SELECT item_id, greatest((item_id % 7 + 1) * 5, count(*) + sum(rep))::BIGINT AS n_frames FROM r GROUP BY item_id"""
)
def ctc_required_length(t: Tables):
    # Word lengths as labels: they repeat often.
    tokens = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    n = F.pmod("item_id", F.lit(7)) + 1
    return t.benchmark.select("item_id", A.ctc_required_length(tokens, n, 5).alias("n_frames"))


def _vectors(t: Tables):
    return exploded(t.embeddings, ["vec_id"], n="n", value=F.col("embedding"))


@catalog.add(
    """SELECT vec_id, o AS t, (o * 64) // 100 AS src, round(embedding[(o * 64) // 100 + 1]::DOUBLE, 6) AS value, 'length' AS how
    FROM embeddings, unnest(generate_series(0, 99)) u(o)
    UNION ALL SELECT vec_id, o, o // 5, round(embedding[o // 5 + 1]::DOUBLE, 6), 'ratio' FROM embeddings, unnest(generate_series(0, 319)) u(o)"""
)
def uniform_upsample(t: Tables):
    vectors = _vectors(t)
    by_length = ctc.uniform_upsample(vectors, length=F.lit(100), n="n").df.withColumn("how", F.lit("length"))
    by_ratio = ctc.uniform_upsample(vectors, ratio=5).df.withColumn("how", F.lit("ratio"))
    both = stack_rows(by_length, by_ratio)
    return both.select("vec_id", "t", "src", C.r6(F.col("value"), "value"), "how")


@catalog.add(
    f"""WITH {C.SQL_BENCH_WORDS}, s AS (SELECT *, sum(duration) OVER (PARTITION BY item_id ORDER BY t) - duration AS start FROM words)
    SELECT item_id, (start + k)::BIGINT AS frame, token FROM s, unnest(generate_series(0, duration - 1)) u(k)"""
)
def length_regulate(t: Tables):
    return ctc.length_regulate(C.benchmark_words(t)).df.select("item_id", "frame", "token")


@catalog.add(
    """SELECT vec_id, greatest(label * 7, 1)::BIGINT AS n,
      round(coalesce(list_sum(list_transform(list_slice(embedding, 1, label * 7), lambda x: x::DOUBLE)), 0), 6) AS total FROM embeddings"""
)
def unpad_features(t: Tables):
    cut = A.unpad(F.col("embedding"), F.col("label") * 7, F.lit(0.0).cast("float"))
    return t.embeddings.select("vec_id", cut.alias("v")).select(
        "vec_id", F.size("v").cast("bigint").alias("n"), C.r6(A.array_sum(F.col("v"), "double"), "total")
    )


@catalog.add(
    """SELECT vec_id, f AS frame, round(embedding[f * 5 + 1]::DOUBLE, 6) AS first,
      round(list_sum(list_transform(list_slice(embedding, f * 5 + 1, f * 5 + 5), lambda x: x::DOUBLE)), 6) AS total
    FROM embeddings, unnest(generate_series(0, 11)) u(f)"""
)
def pack_frames(t: Tables):
    packed = t.embeddings.select("vec_id", F.posexplode(A.stack_frames(F.col("embedding"), 5)).alias("frame", "v"))
    return packed.select(
        "vec_id",
        F.col("frame").cast("bigint").alias("frame"),
        C.r6(F.get("v", F.lit(0)), "first"),
        C.r6(A.array_sum(F.col("v"), "double"), "total"),
    )


@catalog.add(
    f"WITH {C.SQL_FRAMES} SELECT user_id, t, value, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM frames"
)
def shift_right(t: Tables):
    return ctc.shift_right(C.user_frames(t), "value").df.select("user_id", "t", "value", "prev")


@catalog.add(
    f"WITH {C.SQL_BENCH_WORDS} SELECT item_id, string_agg(duration::VARCHAR, ' ' ORDER BY t) || ' 0' AS duration FROM words GROUP BY item_id"
)
def eos_pad(t: Tables):
    durations = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    return t.benchmark.select("item_id", A.format_durations(A.eos_pad(durations)).alias("duration"))


@catalog.add(
    """SELECT event_id, len(list_filter(generate_series(0, 14), lambda k: k * (480.0::DOUBLE / 14) + 5 < value))::BIGINT AS bin FROM events"""
)
def bucketize(t: Tables):
    return t.events.select("event_id", numeric.bucketize(F.col("value"), 5.0, 485.0, 16).alias("bin"))


@catalog.add(
    """SELECT event_id, round(ln(value + 1), 6) AS log_duration,
      CASE WHEN event_type = 'view' THEN 0 ELSE greatest(round_even(value * sqrt(2.0::DOUBLE), 0), 0) END::BIGINT AS frames FROM events"""
)
def log_duration(t: Tables):
    logs = t.events.select("event_id", "event_type", numeric.log_duration(F.col("value")).alias("l"))
    back = numeric.duration_frames(F.col("l"), 2.0**0.5, is_pad=F.col("event_type") == "view")
    return logs.select("event_id", C.r6(F.col("l"), "log_duration"), back.alias("frames"))


@catalog.add(
    """WITH s AS (SELECT i, avg(embedding[i]::DOUBLE) AS mean, stddev_pop(embedding[i]::DOUBLE) AS std FROM embeddings, unnest(generate_series(1, 64)) u(i) GROUP BY i)
    SELECT vec_id, i - 1 AS dim, round((embedding[i]::DOUBLE - mean) / std, 6) AS z, round(embedding[i]::DOUBLE, 6) AS back FROM embeddings, s"""
)
def cmvn_apply(t: Tables):
    stats = aggregates.cmvn_stats(t.embeddings, F.col("embedding"))
    normal = aggregates.cmvn_apply(t.embeddings.select("vec_id", F.col("embedding").alias("z")), "z", stats)
    back = aggregates.cmvn_invert(normal.withColumn("back", F.col("z")), "back", stats)
    rows = back.select("vec_id", F.posexplode(F.arrays_zip("z", "back")).alias("dim", "v"))
    return rows.select("vec_id", F.col("dim").cast("bigint").alias("dim"), C.r6(F.col("v.z"), "z"), C.r6(F.col("v.back"), "back"))
