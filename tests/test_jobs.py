"""The jobs end to end on small corpora."""

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.sequences import Sequences
from corpusflow.plans import jobs
from corpusflow.sources.manifests import read_manifest_tsv


def test_tts_manifest(spark):
    samples = spark.createDataFrame([("u1", "hi", "train"), ("u2", "no alignment", "train"), ("u3", "quiet", "dev")], "id string, src_text string, split string")
    rows = []
    for key, phones in (("u1", [("sil", 1.0), ("AH", 2.0), ("sp", 1.0), ("B", 0.2), ("K", 3.0), ("spn", 1.0)]), ("u3", [("sil", 1.0)])):
        at = 0.0
        for t, (phone, length) in enumerate(phones):
            rows.append((key, t, phone, at, at + length))
            at += length
    intervals = Sequences(spark.createDataFrame(rows, "id string, t bigint, phone string, start double, end double"), ("id",), span=2)
    pitch = Sequences(spark.createDataFrame([("u1", t, float(t + 1)) for t in range(6)], "id string, t bigint, value double"), ("id",), span=2)
    energy = pitch.with_columns({"value": F.col("value") * 10})
    got = {r["id"]: r for r in jobs.tts_manifest(samples, intervals, pitch, energy, rate=1.0, hop=1).collect()}
    assert sorted(got) == ["u1", "u3"]
    row, quiet = got["u1"], got["u3"]
    assert (row["src_text"], row["tgt_text"], row["duration"], row["n_frames"], row["all_silent"]) == ("hi", "AH sp K", "2 1 3", 6, False)
    assert (row["start_sec"], row["end_sec"]) == (1.0, 7.2)
    wanted = [(math.log(1) + math.log(2)) / 2, math.log(3), sum(math.log(v) for v in (4, 5, 6)) / 3]
    assert all(math.isclose(a, b) for a, b in zip(row["pitch"], wanted, strict=True))
    assert all(math.isclose(a, b + math.log(10)) for a, b in zip(row["energy"], wanted, strict=True))
    assert (quiet["tgt_text"], quiet["duration"], quiet["pitch"], quiet["n_frames"], quiet["all_silent"]) == ("", "", [], 0, True)
    feature = spark.createDataFrame([("u1", "a.npy"), ("u9", "b.npy")], "id string, audio string")
    kept = jobs.tts_manifest(samples, intervals, pitch, energy, rate=1.0, hop=1, features={"audio": feature})
    assert [(r["id"], r["audio"]) for r in kept.collect()] == [("u1", "a.npy")]


def test_tts_manifest_of_a_long_sample(spark):
    n = 1500
    df = spark.range(n).select(F.lit("u").alias("id"), F.col("id").alias("t"), F.lit("A").alias("phone"))
    intervals = Sequences(df.withColumns({"start": F.col("t") * 1.0, "end": F.col("t") + 1.0}), ("id",), span=100)
    series = Sequences(df.select("id", "t", (F.col("t") + 1.0).alias("value")), ("id",), span=64)
    row = jobs.tts_manifest(df.select("id").distinct(), intervals, series, series, rate=1.0, hop=1).first()
    assert row["n_frames"] == n and len(row["pitch"]) == n and row["tgt_text"] == " ".join("A" * n)
    assert all(math.isclose(p, math.log(i + 1)) for i, p in enumerate(row["pitch"]))


def test_write_tts_corpus(spark, tmp_path):
    rows = [("a", "x.wav", 3, "K AH", "s1", "hi", "1 2", "train", False), ("b", "y.wav", 1, "AH", "s0", "ho", "1", "dev", False), ("c", "z.wav", 0, "", "s2", "", "", "dev", True)]
    manifest = spark.createDataFrame(rows, "id string, audio string, n_frames bigint, tgt_text string, speaker string, src_text string, duration string, split string, all_silent boolean")
    jobs.write_tts_corpus(manifest, f"{tmp_path}/tts")
    back = read_manifest_tsv(spark, f"{tmp_path}/tts/manifest", ["duration", "id", "split"])
    assert sorted(map(tuple, back.collect())) == [("1", "b", "dev"), ("1 2", "a", "train")]
    lines = lambda name: [r["value"] for r in spark.read.text(f"{tmp_path}/tts/{name}").collect()]
    assert sorted(lines("vocab")) == ["AH 2", "K 1"] and sorted(lines("speakers")) == ["s0", "s1"]


def scoring(spark, spoken):
    paths = spark.createDataFrame([("0_pred.wav",), ("1_spk2_pred.wav",)], "path string")
    heard = spark.createDataFrame([("0_pred.wav", spoken)], "path string, tokens array<string>")
    return paths, heard


def test_score_predictions(spark):
    text = "one two three four five"
    paths, heard = scoring(spark, list(text.upper().replace(" ", "|")))
    references = spark.createDataFrame([(0, f" {text} "), (1, "lost")], "idx bigint, text string")
    row = jobs.score_predictions(paths, heard, references).first()
    assert math.isclose(row["bleu"], 100 * math.exp(1 - 6 / 5)) and row["hyp_len"] == 5
    with pytest.raises(Exception, match="pair up"):
        jobs.score_predictions(paths, heard, references.limit(1)).collect()
    gap = spark.createDataFrame([("0_pred.wav",), ("2_pred.wav",)], "path string")
    with pytest.raises(Exception, match="gap"):
        jobs.score_predictions(gap, heard, references).collect()
    twice = spark.createDataFrame([("0_pred.wav",), ("0_spk1_pred.wav",), ("1_pred.wav",)], "path string")
    with pytest.raises(Exception, match="several predictions"):
        jobs.score_predictions(twice, heard, references).collect()


def test_transcripts_are_lines_before_they_are_joined(spark):
    paths, heard = scoring(spark, ["a", "|", "b"])
    references = spark.createDataFrame([(0, "a b"), (1, "lost")], "idx bigint, text string")
    plan = jobs.score_predictions(paths, heard, references)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(tokens") == 1 and plan.index("Join LeftOuter") < plan.index("array_join(tokens")


def test_pairs_are_counted_where_they_meet(spark):
    """No shuffle between the full outer join by position and the counts; small tables are not broadcast there either."""
    paths, heard = scoring(spark, ["a", "|", "b"])
    references = spark.createDataFrame([(0, "a b"), (1, "lost")], "idx bigint, text string")
    plan = jobs.score_predictions(paths, heard, references)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInArrow") : plan.index("FullOuter")]
    assert "Exchange" not in above and "SortMergeJoin" in above


def test_score_hokkien(spark):
    paths, heard = scoring(spark, ["ts", "ua5", "NULLINIT", "e3", "b", "o2", "k", "i1"])
    references = spark.createDataFrame([(0, "tsua5 e3 bo2 ki1"), (1, "x")], "idx bigint, text string")
    row = jobs.score_predictions(paths, heard, references, language="hok", mode="none", silence="</s>").first()
    assert row["hyp_len"] == 4 and row["precision4"] == 100.0


def test_training_batches(spark):
    sized = lambda n, length: spark.range(n).select("id", F.lit(length).cast("bigint").alias("source_len"), F.lit(1).cast("bigint").alias("target_len"))
    sets = {"st": sized(40, 500), "tts": sized(20, 100)}
    plan = {"st": jobs.Modality(2048), "tts": jobs.Modality(100_000, 3, 2.0)}
    batches, rejected = jobs.training_batches(sets | {"tts": sized(20, 100).union(sized(2, 2000))}, plan, 2)
    rows = batches.collect()
    assert len(rows) == 40 + 40 and {r["shard"] for r in rows} <= {0, 1}
    assert [(r["modality"], r["source_len"]) for r in rejected.collect()] == [("tts", 2000)] * 2
    seen = [{(r["modality"], r["bucket"], r["salt"], r["batch"]) for r in rows if r["shard"] == k} for k in range(2)]
    assert not seen[0] & seen[1]
    sizes = {}
    for r in rows:
        key = (r["modality"], r["bucket"], r["salt"], r["batch"])
        sizes[key] = sizes.get(key, 0) + 1
    assert {n for (m, *_), n in sizes.items() if m == "st"} == {4}
    assert max(n for (m, *_), n in sizes.items() if m == "tts") == 3
