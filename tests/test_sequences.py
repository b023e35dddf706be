"""Sequences: the span plan must give what the window plan gives, and both what a loop gives."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import alignment, ctc
from corpusflow.operators.sequences import Sequences, exploded, from_rows, with_position


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def frames(spark):
    """One key with most of the rows, some short ones; positions with holes."""
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 400), ("b", 37), ("c", 1), ("d", 8)):
        for t in sorted(rng.sample(range(n * 2), n)):
            rows.append((key, t, rng.choice("abb__"), rng.random(), rng.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "id string, t bigint, symbol string, value double, mark int")
    return df.repartition(3, "t").cache(), rows


def plans(df):
    yield Sequences(df, ("id",), one_row=True)
    for span in (1, 7, 64, 10_000):
        yield Sequences(df, ("id",), span=span)


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running_sum(frames):
    df, rows = frames
    wanted = []
    for key, group in by_key(rows).items():
        total = 0
        for row in group:
            total += row[1] % 5
            wanted.append((key, row[1], total))
    for plan in plans(df):
        got = plan.running_sum(F.col("t") % 5, "s")
        assert rows_of(got.df, "id", "t", "s") == sorted(wanted)
        assert set(got.df.columns) == {*df.columns, "s"}


def test_previous(frames):
    df, rows = frames
    wanted = []
    for key, group in by_key(rows).items():
        before = [None] + [r[4] for r in group[:-1]]
        wanted += [(key, r[1], -9 if i == 0 else (before[i] if before[i] is not None else 0)) for i, r in enumerate(group)]
    for plan in plans(df):
        got = plan.previous(F.col("mark"), "p", F.lit(-9))
        assert rows_of(got.df.fillna(0, ["p"]), "id", "t", "p") == sorted(wanted)


def test_last_seen(frames):
    df, rows = frames
    wanted = []
    for key, group in by_key(rows).items():
        last = 0
        for row in group:
            last = row[4] if row[4] is not None else last
            wanted.append((key, row[1], last))
    for plan in plans(df):
        got = plan.last_seen(F.col("mark"), "m")
        assert rows_of(got.df.fillna(0, ["m"]), "id", "t", "m") == sorted(wanted)


def test_attach_and_arrays(frames):
    df, rows = frames
    groups = by_key(rows)
    for plan in plans(df):
        got = plan.attach(n=("sum", F.lit(1)), last=("max", F.col("t")), first=("min", F.col("t")))
        facts = {r["id"]: (r["n"], r["first"], r["last"]) for r in got.df.collect()}
        assert facts == {k: (len(g), g[0][1], g[-1][1]) for k, g in groups.items()}
        packed = {r["id"]: r["symbol"] for r in plan.arrays("symbol").collect()}
        assert packed == {k: [r[2] for r in g] for k, g in groups.items()}
        assert [r["id"] for r in plan.longer_than(40).collect()] == ["hot"]


def test_with_position_range_plan(spark, frames):
    df, rows = frames
    shuffled = df.select("id", "t", "symbol")
    wanted = sorted((k, r[1], i) for k, g in by_key(rows).items() for i, r in enumerate(g))
    numbered = with_position(shuffled, ["id"], [F.col("t")], "pos")
    assert rows_of(numbered, "id", "t", "pos") == wanted
    assert numbered.columns == ["id", "t", "symbol", "pos"]
    down = with_position(shuffled, [], [F.col("t").desc(), F.col("id")], "pos")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert rows_of(down, "pos", "id", "t") == [(i, r[0], r[1]) for i, r in enumerate(order)]


def test_null_keys_are_a_sequence(spark):
    rows = [(None, 3.0), (None, 1.0), ("a", 5.0), (None, 2.0), ("a", 4.0), (None, 9.0), (None, 7.0), ("b", 1.0)]
    df = spark.createDataFrame(rows, "id string, value double")
    numbered = from_rows(df, ["id"], [F.col("value")])
    key = lambda r: tuple(map(str, r))
    want = sorted([(None, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 7.0, 9.0])] + [("a", 0, 4.0), ("a", 1, 5.0), ("b", 0, 1.0)], key=key)
    assert sorted(map(tuple, numbered.df.select("id", "t", "value").collect()), key=key) == want
    for plan in (numbered, Sequences(numbered.df, ("id",), span=2), Sequences(numbered.df, ("id",), one_row=True)):
        chain = plan.running_sum(F.col("value"), "s").previous(F.col("value"), "p").last_seen(F.when(F.col("t") % 2 == 0, F.col("t")), "e")
        chain = chain.attach(n=("sum", F.lit(1)))
        got = sorted((tuple(r) for r in chain.df.select("id", "t", "s", "p", "e", "n").collect()), key=key)
        assert got == sorted(
            [(None, 0, 1.0, None, 0, 5), (None, 1, 3.0, 1.0, 0, 5), (None, 2, 6.0, 2.0, 2, 5), (None, 3, 13.0, 3.0, 2, 5), (None, 4, 22.0, 7.0, 4, 5),
             ("a", 0, 4.0, None, 0, 2), ("a", 1, 9.0, 4.0, 0, 2), ("b", 0, 1.0, None, 0, 1)], key=key)


def test_full_rows_move_once(spark, tmp_path):
    """Planned exchanges: the rows, the rows again for the summary of their spans (pruned), the summaries."""
    rows = [(k, t, "ab_"[t % 3], float(t), t + 1.0, "wide" * 9) for k in "xyz" for t in range(50)]
    spark.createDataFrame(rows, "id string, t bigint, symbol string, start double, end double, extra string").write.parquet(f"{tmp_path}/f")
    plan = Sequences(spark.read.parquet(f"{tmp_path}/f"), ("id",), span=8)
    timed = plan.with_columns({"phone": F.col("symbol"), "duration": F.lit(1)})
    for df in (ctc.ctc_index(plan, blank="_").df, alignment.trim_silence(timed, silence=("_",)).df):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 3 and text.count("Join ") == 1
        # The analysis writes columns of an exchange's child; only one child carries the wide column.
        scans = [line for line in text.splitlines() if "FileScan" in line]
        assert len(scans) == 2 and sum("extra" in line for line in scans) == 1


def test_ctc_against_loop(frames):
    df, rows = frames
    runs, labels = [], []
    for key, group in by_key(rows).items():
        run, before = 0, None
        for row in group:
            if row[2] != "_" and row[2] != before:
                run += 1
                labels.append((key, run - 1, row[2], row[1]))
            runs.append((key, row[1], run if row[2] != "_" else 0))
            before = row[2]
    for plan in plans(df):
        assert rows_of(ctc.ctc_index(plan, blank="_").df, "id", "t", "run") == sorted(runs)
        collapsed = ctc.ctc_collapse(plan, blank="_")
        assert rows_of(collapsed.df, "id", "pos", "symbol", "start_frame") == sorted(labels)


def symbols(spark, *values):
    return exploded(
        spark.createDataFrame([(1, list(values))], "id int, s array<int>"), ["id"], symbol=F.col("s")
    )


def test_ctc_fixtures(spark):
    frames = symbols(spark, 0, 0, 5, 5, 0, 5, 7, 7)
    assert [r["symbol"] for r in ctc.ctc_collapse(frames).df.orderBy("pos").collect()] == [5, 5, 7]
    assert [r["run"] for r in ctc.ctc_index(frames).df.orderBy("t").collect()] == [0, 0, 1, 1, 0, 2, 3, 3]
    assert ctc.ctc_lengths(frames).collect()[0]["n_labels"] == 3
    blank = symbols(spark, 0, 0)
    assert ctc.ctc_collapse(blank).df.count() == 0
    assert ctc.ctc_lengths(blank).collect()[0]["n_labels"] == 0


def test_ctc_merge(spark):
    df = spark.createDataFrame(
        [(1, 0, 4, 1.0, 0.2), (1, 1, 4, 3.0, 0.8), (1, 2, 0, 9.0, 0.9), (1, 3, 4, 5.0, 0.5)],
        "id int, t bigint, symbol int, value double, p double",
    )
    frames = Sequences(df, ("id",))
    merged = lambda how: [
        round(r["value"], 6) for r in ctc.ctc_merge(frames, how, F.col("value"), F.col("p")).orderBy("run").collect()
    ]
    assert merged("softmax") == [2.291313, 5.0]
    assert merged("meanpool") == [2.0, 5.0]
    assert merged("maxpool") == [3.0, 5.0]
    assert merged("weighted") == [1.3, 2.5]
    vectors = ctc.ctc_merge(frames, "meanpool", F.array("value", "p"), vector=True)
    assert rows_of(vectors, "run", "dim", "value") == [(1, 0, 2.0), (1, 1, 0.5), (2, 0, 5.0), (2, 1, 0.5)]
    with pytest.raises(ValueError):
        ctc.ctc_merge(frames, "softmax", F.col("value"))


def test_uniform_upsample(spark):
    two = symbols(spark, 10, 20)
    assert [r["src"] for r in ctc.uniform_upsample(two, length=F.lit(5)).df.orderBy("t").collect()] == [0, 0, 0, 1, 1]
    assert [r["src"] for r in ctc.uniform_upsample(two, ratio=2).df.orderBy("t").collect()] == [0, 0, 1, 1]
    for n in range(1, 9):
        for m in (n, n + 1, 2 * n + 1, 37):
            got = ctc.uniform_upsample(symbols(spark, *range(n)), length=F.lit(m)).df.orderBy("t")
            assert [(r["t"], r["src"]) for r in got.collect()] == [(t, t * n // m) for t in range(m)]


def test_length_regulate_and_shift(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "token string, d int")
    tokens = Sequences(df.selectExpr("1 AS id", "CAST(ascii(token) - 97 AS bigint) AS t", "token", "d"), ("id",), span=2)
    out = ctc.length_regulate(tokens, "d").df.orderBy("frame")
    assert [(r["frame"], r["token"]) for r in out.collect()] == [(0, "a"), (1, "a"), (2, "c")]
    shifted = ctc.shift_right(tokens.with_columns({"v": F.col("d") * 1.0}), "v").df.orderBy("t")
    assert [r["prev"] for r in shifted.collect()] == [0.0, 2.0, 0.0]


def test_pack_long_frames(spark):
    packed = ctc.pack_long_frames(symbols(spark, *range(7)), "symbol", 3)
    assert rows_of(packed, "frame", "symbol") == [(0, [0, 1, 2]), (1, [3, 4, 5])]


def intervals(spark, *phones, length=1.0):
    rows = [(1, i, p, i * length, (i + 1) * length) for i, p in enumerate(phones)]
    return Sequences(spark.createDataFrame(rows, "id int, t bigint, phone string, start double, end double"), ("id",), span=2)


def test_trim_silence(spark):
    timed = alignment.frame_durations(intervals(spark, "sil", "AH", "sp", "B", "spn"), 1.0, 1)
    got = alignment.trim_silence(timed).df.orderBy("pos").collect()
    assert [(r["pos"], r["phone"]) for r in got] == [(0, "AH"), (1, "sp"), (2, "B")]
    assert {(r["start_sec"], r["end_sec"]) for r in got} == {(1.0, 4.0)}


def test_trim_silence_all_silent(spark):
    timed = alignment.frame_durations(intervals(spark, "sil", "sp"), 1.0, 1)
    trimmed = alignment.trim_silence(timed)
    assert trimmed.df.count() == 0
    report = alignment.trimmed_samples(timed.df, trimmed).collect()
    assert [tuple(r) for r in report] == [(1, 0, 0, 0.0, 0.0, True)]


def test_short_intervals_are_dropped(spark):
    timed = alignment.frame_durations(intervals(spark, "A", "B", "C", length=0.4), 1.0, 1)
    assert [(r["phone"], r["duration"]) for r in timed.df.orderBy("t").collect()] == [("B", 1)]


def segments_case(spark):
    rng = random.Random(11)
    frames, segments = [], []
    for key, n in (("hot", 300), ("b", 5)):
        frames += [(key, t, rng.random() * 3 - 1) for t in range(n)]
        at, seg = 2, 0
        while at < n - 4:
            length = rng.choice([0, 0, 1, 2, 9])
            segments.append((key, seg, at, at + length))
            at, seg = at + length + rng.choice([0, 0, 1]), seg + 1
    return (
        spark.createDataFrame(frames, "id string, t bigint, value double"),
        spark.createDataFrame(segments, "id string, seg int, start_frame bigint, end_frame bigint"),
        frames,
        segments,
    )


def test_frames_to_segments(spark):
    df, segs, frames, segments = segments_case(spark)
    wanted = sorted((k, t, s) for k, t, _ in frames for q, s, a, b in segments if q == k and a <= t < b)
    for plan in plans(df):
        assert rows_of(alignment.frames_to_segments(plan, segs), "id", "t", "seg") == wanted


def test_segment_mean(spark):
    import math

    df, segs, frames, segments = segments_case(spark)
    for log in (False, True):
        wanted = {}
        for k, s, a, b in segments:
            inside = [v for q, t, v in frames if q == k and a <= t < b]
            inside = [math.log(max(v, 1e-5)) for v in inside] if log else inside
            wanted[k, s] = (round(sum(inside) / len(inside), 9) if inside else 0.0, len(inside))
        for plan in plans(df):
            means = alignment.segment_mean(plan, segs, "value", log_scale=log).collect()
            assert {(r["id"], r["seg"]): (round(r["mean"], 9), r["n_frames"]) for r in means} == wanted


def test_segment_means_joined_with_themselves(spark):
    """Two readings of one union in one plan: the case Spark's union partitioning gets wrong."""
    df, segs, _, _ = segments_case(spark)
    numbered = from_rows(df.drop("t"), ["id"], [F.col("value")])
    once = alignment.segment_mean(numbered, segs, "value")
    again = alignment.segment_mean(numbered, segs, "value").withColumnRenamed("mean", "other")
    joined = once.join(again, ["id", "seg"])
    assert joined.filter("mean <> other").count() == 0
    assert joined.count() == segs.count()


def test_frame_log_energy(spark):
    import math

    series = symbols(spark, *range(1, 12))
    got = alignment.frame_log_energy(series, F.col("symbol").cast("double"), 4, 3).orderBy("frame").collect()
    x = list(range(1, 12))
    assert [(r["frame"], round(r["log_energy"], 9)) for r in got] == [
        (f, round(math.log(sum(v * v for v in x[3 * f : 3 * f + 4])), 9)) for f in range(3)
    ]
    every = alignment.frame_log_energy(series, F.col("symbol").cast("double"), 4, 3, complete_only=False)
    assert every.count() == 4
