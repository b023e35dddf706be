"""Files written by hand or by the library, read back."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.session import scratch_path, shared_dir
from corpusflow.sources import evaluation, features, lines, manifests, vocab


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_manifest_keeps_text_as_it_is(spark, tmp_path):
    odd = [("1", 'say "hi"'), ("2", r"back\slash \" end\\"), ("3", "  spaces  "), ("4", "'q' , ; #x"), ("5", None), ("6", "é ▁ ß")]
    df = spark.createDataFrame(odd, "id string, text string")
    path = str(tmp_path / "m")
    manifests.write_manifest(df, path, ["id", "text"], by=())
    assert rows_of(manifests.read_manifest_tsv(spark, path, ["id", "text"]), "id", "text") == sorted(odd)


def test_manifest_by_hand(spark, tmp_path):
    path = write(tmp_path / "dev.tsv", 'id\taudio\tn_frames\na\t"x\t12\nb\ty"\tmany\n')
    raw = manifests.read_manifest_tsv(spark, path, ["id", "audio", "n_frames"])
    good, bad = manifests.cast_columns(raw, {"n_frames": "int"})
    assert rows_of(good, "id", "audio", "n_frames") == [("a", '"x', 12)]
    assert rows_of(bad, "id", "audio", "n_frames") == [("b", 'y"', "many")]
    wide = write(tmp_path / "wide.tsv", "id\taudio\na\tx\ty\n")
    with pytest.raises(Exception):
        manifests.read_manifest_tsv(spark, wide, ["id", "audio"]).collect()
    with pytest.raises(Exception):
        manifests.read_manifest_tsv(spark, wide, ["id", "audio"]).select("id").collect()


def test_manifest_by_header_name(spark, tmp_path):
    one, two = write(tmp_path / "a.tsv", "n_frames\tid\tmore\n7\tx\t1\n"), write(tmp_path / "b.tsv", "id\tn_frames\ny\t8\n")
    read = manifests.read_manifest_tsv(spark, [one, two], ["id", "n_frames"], {"speaker": "none", "more": None})
    assert rows_of(read, "id", "n_frames", "speaker", "more") == [("x", "7", "none", "1"), ("y", "8", "none", None)]
    assert read.columns == ["id", "n_frames", "speaker", "more"]
    with pytest.raises(ValueError, match="no column text"):
        manifests.read_manifest_tsv(spark, one, ["id", "text"])


def test_grid_of_permuted_headers(spark, tmp_path):
    for lang, header, row in (("fr", "id\tn", "a\t1"), ("de", "n\tid", "2\tb")):
        os.makedirs(tmp_path / lang)
        write(tmp_path / lang / "dev.tsv", f"{header}\n{row}\n")
    grid = manifests.scan_manifest_grid(spark, str(tmp_path) + "/{lang}/{split}.tsv", [("fr", "dev"), ("de", "dev")], ["id", "n"])
    assert rows_of(grid, "lang", "split", "id", "n") == [("de", "dev", "b", "2"), ("fr", "dev", "a", "1")]


def test_reference_column_of_a_tsv(spark, tmp_path):
    path = write(tmp_path / "ref.tsv", "id\ttgt_text\n1\t one \n2\t\n3\tthree\n")
    assert rows_of(lines.read_reference_tsv(spark, path, "tgt_text"), "line_no", "text") == [(0, "one"), (1, ""), (2, "three")]
    with pytest.raises(Exception, match="no column"):
        lines.read_reference_tsv(spark, path, "nope").collect()


def test_unsafe_text_is_set_aside(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, "a\nb"), (3, "ab"), (4, None)], "id int, text string")
    good, bad = manifests.split_tsv_safe(df)
    assert rows_of(good, "id") == [(3,), (4,)] and rows_of(bad, "id") == [(1,), (2,)]
    with pytest.raises(Exception, match="tab or line break in column text"):
        manifests.write_manifest(df, str(tmp_path / "m"), ["id", "text"], by=())
    manifests.write_manifest(good, str(tmp_path / "n"), ["id", "text"], by=())


def test_grid(spark, tmp_path):
    for lang, split in itertools.product(("fr", "de"), ("train", "dev")):
        os.makedirs(tmp_path / f"{lang}-en/src", exist_ok=True)
        write(tmp_path / f"{lang}-en/src/{split}.tsv", f"id\tn\n{lang}{split}\t1\n")
    pattern = str(tmp_path) + "/{lang}-en/src/{split}.tsv"
    grid = manifests.scan_manifest_grid(spark, pattern, itertools.product(("fr", "de"), ("train", "dev")), ["id", "n"])
    assert rows_of(grid, "id", "lang", "split") == [(l + s, l, s) for l in ("de", "fr") for s in ("dev", "train")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.scan_manifest_grid(spark, pattern, [("es", "dev")], ["id", "n"])


def test_replace_manifest_it_was_read_from(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("a", "1", "dev"), ("b", "2", "train")], "id string, n string, split string")
    manifests.write_manifest(df, path, ["id", "n"])
    read = manifests.read_manifest_tsv(spark, path, ["id", "n", "split"])
    kept = manifests.replace_manifest(read.withColumn("n", F.lit("9")), path, ["id", "n"])
    assert rows_of(manifests.read_manifest_tsv(spark, path, ["id", "n", "split"]), "id", "n", "split") == [("a", "9", "dev"), ("b", "9", "train")]
    assert rows_of(manifests.read_manifest_tsv(spark, kept, ["id", "n", "split"]), "n") == [("1",), ("2",)]


def test_pairs_tsv(spark, tmp_path):
    path = write(tmp_path / "train.tsv", 'a.mp3\tone "two"\nb\tx\ty\nc\n\nd\t\n')
    good, bad = lines.read_pairs_tsv(spark, path)
    assert rows_of(good, "id", "text") == [("a.mp3", 'one "two"'), ("d", "")]
    assert rows_of(bad, "value") == [("",), ("b\tx\ty",), ("c",)]


def test_reference_lines_keep_blank_lines(spark, tmp_path):
    path = write(tmp_path / "ref.txt", "  one \n\n three\r\n\t\nfive")
    assert rows_of(lines.read_reference_lines(spark, path), "line_no", "text") == [(0, "one"), (1, ""), (2, "three"), (3, ""), (4, "five")]


def test_line_numbers_across_blocks(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    path = write(tmp_path / "big.txt", "\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        numbered = lines.numbered_lines(spark, path)
        assert numbered.select("line_no", "value").orderBy("line_no").collect() == list(enumerate(text))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_token_list(spark, tmp_path):
    path = write(tmp_path / "dict.txt", "AH0 12\nB 7\n| 3\n")
    tokens = lines.read_token_list(spark, path)
    ids = vocab.vocab_ids(tokens, [F.col("line_no")])
    assert dict(rows_of(ids, "token", "id"))["|"] == 6 and ids.count() == 7


def test_list_predictions(spark):
    paths = spark.createDataFrame([("w/0_pred.wav",), ("w/1_spk7_pred.wav",), ("w/notes.txt",), ("w/x_pred.wav",)], "path string")
    assert rows_of(evaluation.list_predictions(paths), "idx", "path") == [(0, "w/0_pred.wav"), (1, "w/1_spk7_pred.wav")]
    assert evaluation.prediction_problems(paths).count() == 0


def test_prediction_problems(spark):
    names = ["0_pred", "2_pred", "3_spk1_pred", "3_spk2_pred", "4_pred", "4_spk2_pred"]
    paths = spark.createDataFrame([(f"w/{n}.wav",) for n in names], "path string")
    assert rows_of(evaluation.prediction_problems(paths), "idx", "problem") == [
        (2, "gap before this index"), (3, "several speaker variants"), (4, "speaker variant beside the plain file")
    ]
    with pytest.raises(Exception, match="several predictions|gap"):
        evaluation.list_predictions(paths).collect()


def test_prediction_listing(spark, tmp_path):
    for name in ("0_pred.wav", "1_spk3_pred.wav", "log.txt"):
        write(tmp_path / name, "x")
    found = evaluation.list_predictions(evaluation.prediction_paths(spark, str(tmp_path)))
    assert [r["idx"] for r in found.orderBy("idx").collect()] == [0, 1]


def test_saved_pairs(spark, tmp_path):
    pairs = [(0, 'a "b"', "A"), (1, "", "B"), (2, "c", "")]
    path = str(tmp_path / "pairs")
    evaluation.save_pairs(spark.createDataFrame(pairs, "idx bigint, prediction string, reference string"), path)
    assert rows_of(evaluation.load_pairs(spark, path), "idx", "prediction", "reference") == pairs


def test_transcripts_in_order(spark, tmp_path):
    path = str(tmp_path / "pred")
    df = spark.range(100).select((99 - F.col("id")).alias("idx"), F.when(F.col("id") == 3, None).otherwise(F.concat(F.lit("t"), (99 - F.col("id")).cast("string"))).alias("text"))
    evaluation.write_transcripts(df.repartition(7), path)
    parts = sorted(n for n in os.listdir(path) if n.startswith("part"))
    text = "".join(open(os.path.join(path, n)).read() for n in parts).split("\n")[:-1]
    assert text == ["" if i == 96 else f"t{i}" for i in range(100)]


def test_features(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], "id int, frames array<array<double>>")
    features.write_features(df, path)
    stored = spark.read.parquet(path)
    assert stored.first()["frames"] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]
    index = features.feature_index(stored).first()
    assert index["n_frames"] == 2 and "/f/" in index["location"]


def test_shared_dir_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        assert shared_dir(spark) == configured
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(shared_dir(spark))
