"""Long-form zero frames, ties, headers without jobs, lists over part files, layouts, run folders."""

import gzip
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import aggregates, ctc, joins, similarity
from corpusflow.operators.sequences import Sequences, from_rows
from corpusflow.session import run_scope, scratch_path, shared_dir, written
from corpusflow.sources import lines, manifests, vocab


def test_a_sequence_of_length_zero_keeps_a_zero_frame(spark):
    rows = [("hot", t, float(t + 1), 700) for t in range(900)] + [(None, t, 5.0, 0) for t in range(3)] + [("one", 0, 2.0, 1), ("bare", 0, 3.0, 0)]
    df = spark.createDataFrame(rows, "key string, t long, value double, n long")
    for span in (4, 1 << 16):
        cut = ctc.unpad(Sequences(df, ("key",), span=span), F.col("n"), "value").df
        found = {r.key: (r["count"], r.total) for r in cut.groupBy("key").agg(F.count("*").alias("count"), F.sum("value").alias("total")).collect()}
        assert found == {"hot": (700, sum(range(1, 701))), None: (1, 0.0), "one": (1, 2.0), "bare": (1, 0.0)}
    assert ctc.unpad(Sequences(df, ("key",)), F.col("n")).df.filter("key = 'bare'").count() == 0
    assert ctc.unpad(Sequences(df.limit(0), ("key",)), F.col("n"), "value").df.count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_ties_of_the_registry_and_of_targets_have_one_outcome(spark, order):
    source = [("a", "x", 1, 5), ("a", "y", 0, 5), ("a", "z", 9, None), (None, "n", 1, 1)][::order]
    source = spark.createDataFrame(source, "id string, src_audio string, src_n_frames long, priority int").coalesce(1)
    target = spark.createDataFrame([], "id string, tgt_audio string, tgt_n_frames long, pitch long, energy long, priority int")
    merged = {r.id: (r.src_audio, r.src_n_frames, r.n_source) for r in joins.merge_registry(source, target).collect()}
    assert merged["a"] == ("y", 0, 3)
    texts = spark.createDataFrame([("p", "one", 3), ("p", "two", 3), ("p", "old", 1)][::order], "path string, text string, line_no long").coalesce(1)
    clips = spark.createDataFrame([("p", "")], "path string, translation string")
    assert joins.override_target(clips, texts).first().translation == "two"


def jobs_of(spark, build) -> int:
    group = scratch_path(spark, "jobs").rsplit("/", 1)[1]
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers_of_a_grid_cost_no_jobs(spark, tmp_path):
    cells = [(lang, split) for lang in ("fr", "de", "es") for split in ("train", "dev")]
    for i, (lang, split) in enumerate(cells):
        os.makedirs(tmp_path / lang, exist_ok=True)
        names = ["id", "n"] if i % 2 else ["n", "id"]
        row = {"id": lang + split, "n": str(i)}
        (tmp_path / lang / f"{split}.tsv").write_text("\t".join(names) + "\n" + "\t".join(row[c] for c in names) + "\n")
    grids = []
    build = lambda: grids.append(manifests.scan_manifest_grid(spark, str(tmp_path) + "/{lang}/{split}.tsv", cells, ["id", "n"]))
    assert jobs_of(spark, build) == 0
    assert sorted((r.lang, r.split, r.id, r.n) for r in grids[0].collect()) == sorted((a, b, a + b, str(i)) for i, (a, b) in enumerate(cells))


def test_headers_of_folders_of_packed_files_and_of_patterns(spark, tmp_path):
    os.makedirs(tmp_path / "m" / "split=dev")
    (tmp_path / "m" / "_SUCCESS").write_text("")
    (tmp_path / "m" / ".hidden").write_text("no\theader\n")
    (tmp_path / "m" / "split=dev" / "part-0").write_text("id\ttext\na\tb\n")
    read = manifests.read_manifest_tsv(spark, str(tmp_path / "m"), ["text", "id"])
    assert [tuple(r) for r in read.collect()] == [("b", "a")]
    with gzip.open(tmp_path / "packed.tsv.gz", "wt") as out:
        out.write("text\tid\nc\td\n")
    assert [tuple(r) for r in manifests.read_manifest_tsv(spark, str(tmp_path / "*.tsv.gz"), ["id", "text"]).collect()] == [("d", "c")]


def test_lists_are_numbered_over_their_part_files(spark, tmp_path):
    path = str(tmp_path / "speakers")
    rows = spark.range(3_000).select(F.format_string("s%05d", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("speaker"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        vocab.write_speakers(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 1
    found = sorted((r.line_no, r.token) for r in lines.read_token_list(spark, path).collect())
    assert found == list(enumerate(sorted({r.speaker for r in rows.collect()})))
    with pytest.raises(Exception, match="no column"):
        lines.read_reference_tsv(spark, path, "nope").collect()


def test_a_layout_is_one_table_and_a_run_leaves_nothing(spark):
    with run_scope(spark) as folder:
        df = spark.range(1_000).select((F.col("id") % 3).alias("key"), (1_000 - F.col("id")).alias("at"))
        placed = from_rows(df, ["key"], [F.col("at")])
        assert len(os.listdir(folder)) == 1
        with run_scope(spark, "inner") as inner:
            written(placed.df, "again")
            assert len(os.listdir(inner)) == 1
        assert not os.path.exists(inner) and placed.df.filter("t = 0").count() == 3
    assert not os.path.exists(folder) and os.path.isdir(shared_dir(spark))
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")


def plain_scores(x, y):
    d = [a - b for a, b in zip(x, y)]
    norm = lambda v: max(sum(a * a for a in v) ** 0.5, 1e-8)
    dot = sum(a * b for a, b in zip(x, y))
    smooth = sum(0.5 * v * v if abs(v) < 1 else abs(v) - 0.5 for v in d)
    return {"cosine": dot / (norm(x) * norm(y)), "l1": -sum(map(abs, d)), "l2": -sum(v * v for v in d), "smoothl1": -smooth, "dot": dot}


def test_matrix_scores_are_those_of_single_pairs(spark):
    draw = random.Random(6)
    vector = lambda n: [draw.uniform(-2, 2) for _ in range(n)]
    sides = [[(p, vector(4)) for p in range(21)] + [(21, None), (22, [1.0, None, 0.0, 2.0]), (23, vector(2)), (24, []), (25, [0.0] * 4)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "pos long, vec array<double>") for s in sides]
    pairs = similarity.pair_similarity(*frames, *similarity.METRICS, batch_rows=9).collect()
    known = [dict(s) for s in sides]
    sizes = [len([p for p in known[0] if p // 9 == b]) for b in range(3)]
    assert len(pairs) == sum(n * n for n in sizes)
    for r in pairs:
        x, y = known[0][r.batch * 9 + r.i], known[1][r.batch * 9 + r.j]
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            assert all(r[m] is None for m in similarity.METRICS)
        else:
            for m, want in plain_scores(x, y).items():
                assert abs(r[m] - want) < 1e-9, (m, r)
    assert similarity.pair_similarity(frames[0].limit(0), frames[1]).count() == 0


def test_moments_far_from_zero_keep_their_precision(spark):
    rows = np.random.default_rng(3).normal(size=(4_000, 3)) * [1e-3, 1.0, 0.0] + [1e9, -5.0, 7.0]
    df = spark.createDataFrame([(r,) for r in rows.tolist()] + [(None,), ([1.0, None, 2.0],)], "frame array<double>").repartition(7)
    stats = aggregates.cmvn_stats(df, F.col("frame"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange")  # of the one row of moments
    found = {r.dim: (r.mean, r.std) for r in stats.collect()}
    centre = rows.mean(axis=0)
    want = np.maximum(np.sqrt(((rows - centre) ** 2).mean(axis=0)), aggregates.STD_FLOOR)
    assert all(abs(found[k][0] - centre[k]) < 1e-5 for k in range(3)) and abs(found[1][1] / want[1] - 1) < 1e-9 and found[2][1] == want[2]
    assert aggregates.cmvn_stats(df.limit(0), F.col("frame")).count() == 0
