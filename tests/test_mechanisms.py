"""Overlap joins, sketches, grouping sets, permutations, archives, the registry stream, table functions, stored layouts, differences."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.permutation import grid, permute
from corpusflow.operators import bleu, difference, intervals, records, sketches
from corpusflow.session import scratch_path, written
from corpusflow.sources import layout, packed
from corpusflow.streaming import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Overlap joins.


def spans(n, seed, longest):
    """A hot key, null keys, nested, equal, empty, backward and open intervals, and one as long as all."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randint(-50, 400)
        rows.append((None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", start, start + draw.choice((0, 1, 2, 5, longest, -3)), i))
    return [*rows, ("hot", -1_000, 100_000, n), ("hot", None, 5, n + 1), ("hot", 5, None, n + 2), ("only" + str(seed), 0, 9, n + 3)]


def brute_overlaps(a, b):
    whole = lambda rows: [r for r in rows if r[1] is not None and r[2] is not None and r[2] > r[1]]
    return sorted((x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in whole(a) for y in whole(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


@pytest.mark.parametrize("width,longest", [(1, 30), (8, 700), (1_000, 5)])
def test_overlaps_are_those_of_brute_force(spark, width, longest):
    schema = "key string, start long, end long, i int"
    a, b = spans(220, 1, longest), spans(150, 2, 40)
    met = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"], width=width)
    found = met.select("key", "left.i", F.col("right.i").alias("j"), "overlap_start", "overlap_end").collect()
    assert sorted((r.i, r.j, r.overlap_start, r.overlap_end) for r in found) == brute_overlaps(a, b)
    assert any(r.key is None for r in found)
    plan = plan_of(met)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_of_seconds_and_of_empty_tables(spark):
    schema = "key string, start double, end double, i int"
    a = [("k", i * 0.3, i * 0.3 + 0.45, i) for i in range(40)]
    df = spark.createDataFrame(a, schema)
    found = intervals.overlap_join(df, df, ["key"], width=0.5).select("left.i", F.col("right.i").alias("j")).collect()
    assert sorted(map(tuple, found)) == sorted((x[3], y[3]) for x in a for y in a if x[1] < y[2] and y[1] < x[2])
    empty = spark.createDataFrame([], schema)
    assert intervals.overlap_join(df, empty, ["key"]).count() == intervals.overlap_join(empty, df, ["key"]).count() == 0


def test_a_long_segment_is_no_row_for_each_frame(spark):
    frames = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("t"))
    segments = spark.createDataFrame([(1, 0, 20_000, "all"), (1, 3, 5, "some")], "key int, start_frame long, end_frame long, name string")
    whole = intervals._leveled(segments, ["key"], ("start_frame", "end_frame"), 64)
    assert intervals._binned(whole, F.array(*[F.lit(i) for i in range(6)]), 64, "r").count() <= 2 * 2 * 6
    covered = intervals.frames_in_segments(frames, segments, ["key"])
    assert {r["name"]: r["count"] for r in covered.groupBy("name").count().collect()} == {"all": 20_000, "some": 2}


@pytest.mark.parametrize("members,size", [(3, 5), (2, 1_000), (1_000, 4)])
def test_lists_and_slices_lose_no_pair(spark, monkeypatch, members, size):
    monkeypatch.setattr(intervals, "MEMBERS", members)
    monkeypatch.setattr(intervals, "SLICE", size)
    schema = "key string, start long, end long, i int"
    a, b = spans(150, 1, 30), spans(150, 2, 40)
    b += b[:40]  # rows that come twice
    met = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["key"], width=8)
    assert met.columns == ["key", "left", "right", "overlap_start", "overlap_end"]
    found = met.select("key", "left.*", F.col("right.i").alias("j"), F.col("right.start").alias("s"), "overlap_start", "overlap_end").collect()
    assert sorted((r.i, r.j, r.overlap_start, r.overlap_end) for r in found) == brute_overlaps(a, b)
    assert {(r.key, r.start, r.end, r.i) for r in found} <= set(a) and {(r.s, r.j) for r in found} <= {(x[1], x[3]) for x in b}


def test_a_hot_place_of_a_key_is_many_join_keys(spark):
    """All in one bin: no join key has more than its share of rows, and each row of the left meets each of the right once."""
    n = 40_000
    sides = [spark.range(n).select(F.lit(None).cast("long").alias("key"), (F.col("id") % 3).alias("start"), F.lit(8).alias("end"), "id") for _ in range(2)]
    lists = [intervals._gathered(intervals._leveled(df, ["key"], ("start", "end"), 8)) for df in sides]
    assert n / intervals.MEMBERS <= lists[0].count() <= n / intervals.MEMBERS + 3
    cells = [intervals._binned(df, F.array(F.lit(0)), 8, side) for df, side in zip(lists, "lr", strict=True)]
    for df, side in zip(intervals._sliced(*cells), "lr", strict=True):
        held = df.groupBy("_key", "_at", "_bin", "_i", "_j").agg(F.sum(F.size(f"_{side}._rows")).alias("n")).collect()
        assert len(held) == 25 and max(r.n for r in held) < 2 * intervals.SLICE and sum(r.n for r in held) == 5 * n


def test_pairs_of_a_hot_place_are_made_in_pieces_and_by_many_tasks(spark, monkeypatch):
    """The loop that makes pairs is not fused with the join, which would hold a list's rows with all that they meet; lists hold what differs."""
    monkeypatch.setattr(intervals, "MEMBERS", 300)
    monkeypatch.setattr(intervals, "PAIRS", 512)
    sides = [spark.range(n).select(F.when(F.col("id") >= 0, "k").alias("key"), (F.col("id") % 3).alias("start"), F.lit(8).alias("end"), "id") for n in (1_500, 700)]
    met = intervals.overlap_join(*sides, ["key"], width=8).select("left.id", F.col("right.id").alias("j"), "left.start", F.col("right.end").alias("end"))
    assert met.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert met.distinct().count() == met.count() == 1_500 * 700 and met.filter("start <> id % 3 OR end <> 8").count() == 0
    met.collect()
    lines = plan_of(met).split("Initial Plan")[0].splitlines()
    fused = {name: next(re.search(r"\*\((\d+)\)", x).group(1) for x in lines if name in x) for name in ("Generate inline", "Join [_key")}
    assert fused["Generate inline"] != fused["Join [_key"]
    held = intervals._leveled(sides[0], ["key"], ("start", "end"), 8, intervals._shared(sides[0], ["key", "start", "end"]))
    assert held.schema["_row"].dataType.names == ["id"]


def test_rows_of_pairs_are_the_rows_that_came_in(spark):
    """Equal values that are not the same value, keys of two types, names with dots, and nothing besides key and span."""
    a = spark.createDataFrame([(0.0, 1, 5, "x"), (-0.0, 1, 5, "y"), (1.0, 2, 3, "z")], "key double, start long, end long, `a.b` string")
    found = intervals.overlap_join(a, a.select("key", F.col("start").cast("double"), "end"), ["key"], width=4)
    assert found.schema["left"].dataType.names == a.columns and found.schema["right"].dataType["start"].dataType.simpleString() == "double"
    rows = sorted((str(r.left.key), r.left["a.b"], str(r.right.key), r.right.start, r.right.end) for r in found.collect())
    assert rows == [(k, n, other, 1.0, 5) for k, n in (("-0.0", "y"), ("0.0", "x")) for other in ("-0.0", "0.0")] + [("1.0", "z", "1.0", 2.0, 3)]
    few = spark.createDataFrame([(7, 0, 4), (7, 3, 9)], "key int, start int, end int")
    pairs = intervals.overlap_join(few, few.select(F.col("key").cast("long"), "start", "end"), ["key"], width=4)
    assert [pairs.schema[c].dataType["key"].dataType.simpleString() for c in ("left", "right")] == ["int", "bigint"]
    assert {(r.left.key, r.right.key) for r in pairs.collect()} == {(7, 7)} and pairs.count() == 4


def test_frames_at_one_position_meet_a_segment_once(spark):
    """Many sequences under the null key: the totals are those of brute force, from a row for each position and segment."""
    frames = [(None if i % 9 else 1, t, None if (i + t) % 5 == 0 else float(i * t % 13)) for i in range(40) for t in range(30)] + [(2, 0, None)]
    phones = [(None if i % 4 else 1, i // 2, i % 30, i % 30 + i % 7) for i in range(120)] + [(2, 900, 0, 3), (3, 901, 0, 3)]
    tier = spark.createDataFrame(phones, "user_id long, phone long, start long, end long")
    at = intervals.moments(spark.createDataFrame(frames, "user_id long, t long, value double"), ["user_id"], "value")
    covered = intervals.frames_in_segments(at, tier, ["user_id"], span=("start", "end"))
    assert covered.count() == sum(min(e, 30 if k != 2 else 1) - s for k, _, s, e in phones if k != 3)
    found = covered.groupBy("user_id", "phone").agg(F.sum("n_frames"), F.sum("n_values"), F.sum("total")).collect()
    wanted = {}
    for key, phone, start, end in phones:
        for values in [[v for k, t, v in frames if k == key and start <= t < end]]:
            if values:
                wanted.setdefault((key, phone), []).extend(values)
    whole = {k: [v for v in values if v is not None] for k, values in wanted.items()}
    assert {(r[0], r[1]): tuple(r)[2:] for r in found} == {k: (len(wanted[k]), len(v), sum(v) if v else None) for k, v in whole.items()}


# Sketches.


def test_stored_sketches_merge_within_their_errors(spark):
    lengths = spark.range(30_000).select((F.col("id") % 4).alias("shard"), (F.xxhash64("id") % 10_000).alias("length"), (F.col("id") % 7_000).cast("string").alias("symbol"))
    nulls = spark.createDataFrame([(9, None, None)] * 5, "shard long, length long, symbol string")
    rows = lengths.unionAll(nulls).withColumn("symbols", F.array("symbol"))
    shards = written(sketches.sketch(rows, ["shard"], distinct=F.col("symbols"), lengths=F.col("length")), "sketches")
    assert {r.shard: r.n for r in shards.collect()} == {0: 7500, 1: 7500, 2: 7500, 3: 7500, 9: 5}
    halves = sketches.merge_sketches(shards, []), sketches.merge_sketches(sketches.merge_sketches(shards.withColumn("half", F.col("shard") % 2), ["half"]))
    exact = np.sort([r.length for r in lengths.select("length").collect()])
    for merged in halves:
        ranks = (0.01, 0.25, 0.5, 0.9, 0.99)
        row = merged.select("n", sketches.distinct_estimate().alias("d"), *[sketches.quantile_estimate(r).alias(f"q{i}") for i, r in enumerate(ranks)]).first()
        assert row.n == 30_005 and abs(row.d - 7_000) <= sketches.DISTINCT_ERROR * 7_000
        for i, r in enumerate(ranks):
            low, high = np.searchsorted(exact, row[f"q{i}"]) / len(exact), np.searchsorted(exact, row[f"q{i}"], "right") / len(exact)
            assert low - sketches.RANK_ERROR <= r <= high + sketches.RANK_ERROR
    empty = shards.filter("shard = 9").select(sketches.quantile_estimate(0.5).alias("q"), sketches.distinct_estimate().alias("d")).first()
    assert empty.q is None and empty.d == 0
    assert sketches.sketch(rows.limit(0), ["shard"], distinct=F.col("symbols"), lengths=F.col("length")).count() == 0


# Grouping sets.


def test_grouping_sets_are_the_scores_of_each_grouping(spark):
    draw = random.Random(4)
    sentence = lambda: " ".join(draw.choice("abcde") for _ in range(draw.randint(0, 12)))
    rows = [(i, "hot" if i % 3 else None, draw.choice("xyz"), sentence(), sentence()) for i in range(150)]
    pairs = spark.createDataFrame(rows, "idx int, src string, tgt string, prediction string, reference string")
    sets = [["src", "tgt"], ["src"], ["tgt"], []]
    scored = bleu.bleu_grouping_sets(pairs, ["src", "tgt"], sets)
    plan = plan_of(scored)
    assert plan.count("Exchange") == 2 and plan.count("MapInArrow") == 1
    found = {(r.level, r.src, r.tgt): (round(r.bleu, 9), r.hyp_len) for r in scored.collect()}
    want = {}
    for level, one in enumerate(sets):
        for r in bleu.corpus_bleu(pairs, by=one).collect():
            want[(level, r.src if "src" in one else None, r.tgt if "tgt" in one else None)] = (round(r.bleu, 9), r.hyp_len)
    assert found == want and (1, None, None) in found and (3, None, None) in found
    assert bleu.bleu_grouping_sets(pairs.limit(0), ["src", "tgt"], [["src"]]).count() == 0


# Permutations.


@pytest.mark.parametrize("n", [*range(1, 20), 97, 1_000, 4_096])
def test_permutations_are_bijective(spark, n):
    a, b = grid(n)
    assert n <= a * b < n + a
    rows = permute(permute(spark.range(n), "id", n, 1, 1, "x"), "id", n, 1, 2, "y").collect()
    assert sorted(r.x for r in rows) == sorted(r.y for r in rows) == list(range(n))
    if n > 90:
        assert [r.x for r in rows] != [r.y for r in rows] and sum(r.x == r.id for r in rows) < n / 10


def test_permutations_cost_no_shuffle_and_know_nulls(spark):
    placed = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "place long, _name string")
    permuted = permute(placed, "place", 2, 5, 1)
    assert "Exchange" not in plan_of(permuted) and permuted.columns == ["place", "_name", "pos"]
    assert {r["_name"]: r.pos is None for r in permuted.collect()} == {"a": False, "b": False, "c": True}
    assert permute(spark.range(0), "id", 0, 1, 1).count() == 0


# Archives.


def matrices(n=60):
    draw = np.random.default_rng(1)
    rows = [(f"s/{i} ü", draw.normal(size=(i % 7, 3)).astype(np.float32).tolist()) for i in range(n)]
    return [*rows, ("none", None), ("wide", draw.normal(size=(2, 500)).astype(np.float32).tolist())]


def archived(spark, rows, **options):
    folder = scratch_path(spark, "archives")
    df = spark.createDataFrame(rows, "id string, frames array<array<float>>").repartition(3)
    return folder, written(packed.pack_features(df, folder, **options), "index")


def test_archives_give_back_what_was_packed_by_either_way(spark):
    rows = matrices()
    folder, index = archived(spark, rows, archive_bytes=4_000)
    want = {name: frames for name, frames in rows if frames is not None}
    assert {r.id: r.n_frames for r in index.collect()} == {k: len(v) for k, v in want.items()}
    assert len(glob.glob(f"{folder}/*.zip")) > 3
    fetched = packed.fetch(index.withColumn("extra", F.lit(1)))
    assert fetched.columns == ["id", "location", "n_frames", "extra", "frames"]
    assert {r.id: r.frames for r in fetched.collect()} == want
    packed.register(spark)
    for split in (700, 1 << 20):
        scanned = spark.read.format("packed_features").option("splitBytes", split).load(folder)
        assert {r.id: (r.location, r.n_frames, r.frames) for r in scanned.collect()} == {r.id: (r.location, r.n_frames, want[r.id]) for r in index.collect()}
        assert scanned.count() == len(want)
    shapes = spark.read.format("packed_features").option("frames", "false").load(folder)
    assert {r.id: (r.n_frames, r.frames) for r in shapes.collect()} == {k: (len(v), None) for k, v in want.items()}
    one = spark.read.format("packed_features").load(folder).filter(F.col("id") == "wide")
    assert one.count() == 1


def test_only_the_ranges_asked_for_are_read(spark):
    folder, index = archived(spark, matrices(), archive_bytes=1 << 20)
    asked = index.filter("id = 'wide'").first()
    path, start, length = asked.location.rsplit(":", 2)
    ranges = packed.Ranges()
    assert ranges.matrix(path, int(start), int(length)).shape == (2, 500) and ranges.bytes_read == int(length) < os.path.getsize(path)
    ranges.close()
    reader = packed._Reader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    later = GreaterThan(("n_frames",), 3)
    assert list(reader.pushFilters([EqualTo(("id",), "wide"), In(("id",), ("wide", "s/1 ü")), later])) == [later]
    assert [row[0] for part in reader.partitions() for row in reader.read(part)] == ["wide"]


def test_leftovers_of_failed_attempts_are_in_no_index(spark):
    folder, index = archived(spark, matrices(5))
    stray = packed._Archive(folder)
    stray.add("ghost", [[1.0]])
    stray.close()
    assert "ghost" not in {r.id for r in packed.fetch(index).collect()}


def test_archives_of_an_empty_table(spark):
    folder, index = archived(spark, [])
    packed.register(spark)
    assert packed.fetch(index).count() == 0 == spark.read.format("packed_features").load(folder).count()


# The registry stream.


def test_stream_over_drops_is_the_batch_over_all(spark):
    schema = "id string, priority int, audio string, n long"
    columns = ["audio", "n"]
    drops = [
        [("a.mp3", 1, "a1", 1), ("hot", 5, "h5", 5), (None, 9, "none", 0), ("tie", 2, "x", 1)] + [("hot", i % 5, f"h{i % 5}", 0) for i in range(200)],
        [("a", 3, "a3", 3), ("b", None, "b?", 0), ("tie", 2, "y", 0), ("hot", 4, "late", 4)],
        [("a.mp3", 2, "late", 2), ("b", 1, "b1", 1), ("a.mp3", 1, "a1", 1), ("c", None, None, None)],
    ]
    folder = scratch_path(spark, "stream")
    for number, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{folder}/claims/{number}")
        registry.run_registry(registry.claims_from_files(spark, f"{folder}/claims", schema), folder, columns)
    registry.run_registry(registry.claims_from_files(spark, f"{folder}/claims", schema), folder, columns)  # nothing new
    whole = spark.createDataFrame([row for rows in drops for row in rows], schema)
    want = {tuple(r) for r in registry.newest(whole, columns).collect()}
    assert {tuple(r) for r in registry.read_registry(spark, folder, columns).collect()} == want
    assert want == {("a", 3, "a3", 3), ("hot", 5, "h5", 5), ("b", 1, "b1", 1), ("tie", 2, "y", 0), ("c", None, None, None)}


# Table functions.


def test_a_record_that_fails_halfway_leaves_its_error_only(spark):
    def halves(record):
        for i, part in enumerate(record.split(",")):
            yield i, int(part)

    df = spark.createDataFrame([(1, "4,5"), (2, "6,x,7"), (3, None), (4, "8")], "key int, record string")
    found = records.explode_records(df, halves, "record", "at int, value int").collect()
    good = sorted((r.key, r["at"], r.value) for r in found if r.error is None)
    assert good == [(1, 0, 4), (1, 1, 5), (4, 0, 8)]
    assert sorted((r.key, r["at"], r.error.split(":")[0]) for r in found if r.error) == [(2, None, "ValueError"), (3, None, "AttributeError")]
    nothing = records.explode_records(df, lambda r: [], "record", "at int", keep=True)
    assert nothing.columns == ["key", "record", "at", "error"] and nothing.count() == 0
    narrow = records.explode_records(df, lambda r: [(1, 2)], "record", "at int")
    assert all("rows of 1 values" in r.error for r in narrow.collect())
    assert records.explode_records(df.limit(0), halves, "record", "at int, value int").count() == 0


# Stored layouts.


def test_tables_stored_by_key_meet_without_a_shuffle(spark):
    path = scratch_path(spark, "stored")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), "id")
    many = layout.store_by_key(rows, f"{name}_a", f"{path}/a", "key", 4)
    one = layout.store_by_key(rows.groupBy("key").agg(F.max("id").alias("last")), f"{name}_b", f"{path}/b", "key", 4)
    met = many.hint("merge").join(one, "key")
    assert "Exchange" not in plan_of(met) and met.count() == 2_000
    assert "Exchange" not in plan_of(many.groupBy("key").count())
    other = rows.withColumn("other", F.lit(1)).hint("merge").join(one, "key")
    assert plan_of(other).count("Exchange") == 1  # the side that is not stored


# Differences.


def test_changes_of_a_multiset(spark):
    schema = "a string, b int"
    old = [("hot", 1)] * 50 + [("gone", None)] * 2 + [(None, None)] * 3 + [("same", 1)] * 4
    new = [("hot", 1)] * 70 + [("new", 2)] + [(None, None)] + [("same", 1)] * 4
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    changes = {(r.a, r.b): (r.n_old, r.n_new, r.change) for r in difference.row_changes(a, b).collect()}
    assert changes == {("hot", 1): (50, 70, "more"), ("gone", None): (2, 0, "removed"), (None, None): (3, 1, "fewer"), ("new", 2): (0, 1, "added")}
    assert sorted(map(tuple, difference.added_rows(a, b).collect())) == [("hot", 1)] * 20 + [("new", 2)]
    assert difference.common_rows(a, b).count() == 50 + 1 + 4
    empty = a.limit(0)
    assert difference.row_changes(empty, empty).count() == 0 and difference.added_rows(empty, a).count() == len(old)
