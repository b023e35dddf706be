"""Sources and sinks: written to the shared folder, read back, compared with the table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.functions.text import words
from corpusflow.operators import aggregates
from corpusflow.session import scratch_path
from corpusflow.sources import evaluation, features, lines, manifests, vocab

catalog = Catalog()


@catalog.add(
    """SELECT lang, count(*)::BIGINT AS n_rows, sum(n_chars)::BIGINT AS n_frames, count(DISTINCT source)::BIGINT AS n_speakers
    FROM documents GROUP BY lang"""
)
def read_manifest_tsv(t: Tables):
    columns = ["doc_id", "lang", "source", "n_chars"]
    path = scratch_path(t.spark, "manifest")
    manifests.write_manifest(t.documents, path, columns, by=())
    typed, _ = manifests.cast_columns(
        manifests.read_manifest_tsv(t.spark, path, columns), {"doc_id": "bigint", "n_chars": "bigint"}
    )
    return typed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_chars").alias("n_frames"),
        F.countDistinct("source").alias("n_speakers"),
    )


@catalog.add(
    f"""SELECT lang, {C.sql_split('doc_id')} AS split, count(*)::BIGINT AS n_rows, sum(n_chars)::BIGINT AS n_frames
    FROM documents GROUP BY 1, 2"""
)
def scan_manifest_grid(t: Tables):
    path = scratch_path(t.spark, "grid")
    tagged = t.documents.withColumn("split", C.split_of(F.col("doc_id")))
    manifests.write_manifest(tagged, path, ["doc_id", "n_chars"], by=("lang", "split"))
    # The grid is what the catalogue of the corpus lists: its languages and splits, whatever they are.
    cells = tagged.select("lang", "split").distinct().collect()
    grid = manifests.scan_manifest_grid(t.spark, path + "/lang={lang}/split={split}", map(tuple, cells), ["doc_id", "n_chars"])
    return grid.groupBy("lang", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_chars").cast("bigint")).alias("n_frames")
    )


@catalog.add(
    f"""SELECT item_id AS idx, lower({C.sql_one_line('text')}) AS prediction, {C.sql_one_line('text')} AS reference
    FROM benchmark"""
)
def eval_pairs_io(t: Tables):
    path = scratch_path(t.spark, "pairs")
    text = C.one_line(F.col("text"))
    evaluation.save_pairs(
        t.benchmark.select(F.col("item_id").alias("idx"), F.lower(text).alias("prediction"), text.alias("reference")), path
    )
    return evaluation.load_pairs(t.spark, path)


@catalog.add(
    """SELECT vec_id, (i - 1) % 8 AS dim, (i - 1) // 8 AS t, round(embedding[i]::DOUBLE, 6) AS value
    FROM embeddings, unnest(generate_series(1, 64)) u(i)"""
)
def write_features(t: Tables):
    from corpusflow.functions.arrays import stack_frames

    path = scratch_path(t.spark, "features")
    features.write_features(t.embeddings.select("vec_id", stack_frames(F.col("embedding"), 8).alias("frames")), path)
    rows = t.spark.read.parquet(path).select("vec_id", F.posexplode("frames").alias("dim", "_row"))
    rows = rows.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.posexplode("_row").alias("t", "_v"))
    return rows.select("vec_id", "dim", F.col("t").cast("bigint").alias("t"), C.r6(F.col("_v"), "value"))


@catalog.add(
    f"""SELECT item_id || '.mp3' AS id, {C.sql_one_line('text')} AS text FROM benchmark
    WHERE length(text) % 7 <> 0"""
)
def read_pairs_tsv(t: Tables):
    path = scratch_path(t.spark, "pairs")
    # Some lines get a third field; those are set aside.
    extra = F.when(F.length("text") % 7 == 0, F.lit("\tthird")).otherwise(F.lit(""))
    line = F.concat(F.col("item_id").cast("string"), F.lit(".mp3\t"), C.one_line(F.col("text")), extra)
    t.benchmark.select(line.alias("value")).write.text(path)
    pairs, _ = lines.read_pairs_tsv(t.spark, path)
    return pairs


@catalog.add(f"SELECT item_id AS line_no, {C.sql_strip(C.sql_one_line('text'))} AS text FROM benchmark")
def read_reference_lines(t: Tables):
    path = scratch_path(t.spark, "references")
    numbered = F.concat_ws("\t", F.col("item_id").cast("string"), C.one_line(F.col("text")))
    t.benchmark.orderBy("item_id").select(numbered.alias("value")).write.text(path)
    # Each file holds a run of items, so its first item plus the line number must give every item.
    read = lines.numbered_lines(t.spark, path).select(
        "file", "line_no", F.split("value", "\t")[0].cast("bigint").alias("item"), F.split("value", "\t")[1].alias("text")
    )
    first = read.groupBy("file").agg(F.min("item").alias("first"))
    from corpusflow.functions.text import strip

    return read.join(first, "file").select((F.col("first") + F.col("line_no")).alias("line_no"), strip(F.col("text")).alias("text"))


@catalog.add(
    """SELECT doc_id AS idx, 'wav/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_spk7' ELSE '' END || '_pred.wav' AS path
    FROM documents"""
)
def list_predictions(t: Tables):
    speaker = F.when(F.col("doc_id") % 5 == 0, "_spk7").otherwise("")
    name = F.concat(F.lit("wav/"), F.col("doc_id").cast("string"), speaker, F.lit("_pred.wav"))
    return evaluation.list_predictions(t.documents.select(name.alias("path")))


@catalog.add(
    f"""SELECT {C.sql_split(C.sql_hash('doc_id'))} AS split, count(*)::BIGINT AS n_rows, sum(n_chars)::BIGINT AS n_frames
    FROM documents GROUP BY 1"""
)
def write_manifest_by_split(t: Tables):
    from corpusflow.functions.hashing import bucket_hash

    path = scratch_path(t.spark, "splits")
    tagged = t.documents.withColumn("split", C.split_of(bucket_hash(F.col("doc_id"))))
    manifests.write_manifest(tagged, path, ["doc_id", "source", "n_chars"])
    back = manifests.read_manifest_tsv(t.spark, path, ["doc_id", "source", "n_chars", "split"])
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_chars").cast("bigint")).alias("n_frames")
    )


@catalog.add(f"""WITH {C.SQL_BENCH_WORDS} SELECT token, count(*)::BIGINT AS "count" FROM words GROUP BY token""")
def write_vocab(t: Tables):
    path = scratch_path(t.spark, "vocab")
    vocab.write_vocab(aggregates.token_vocab(t.benchmark, words(F.col("text"))), path)
    fields = F.split("value", " ")
    return t.spark.read.text(path).select(fields[0].alias("token"), fields[1].cast("bigint").alias("count"))


@catalog.add(
    f"""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, {C.sql_one_line('text')} AS text FROM conversations"""
)
def write_transcripts(t: Tables):
    path = scratch_path(t.spark, "transcripts")
    evaluation.write_transcripts(
        t.conversations.select("conv_id", "turn", C.one_line(F.col("text")).alias("text")), path, order=("conv_id", "turn")
    )
    read = lines.numbered_lines(t.spark, path)
    # One row per part file.
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = read.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return read.join(starts, "file").select((F.col("start") + F.col("line_no")).alias("pos"), F.col("value").alias("text"))


@catalog.add("SELECT vec_id AS id, 'embeddings.parquet' AS file, len(embedding)::BIGINT AS n_frames FROM embeddings")
def feature_index(t: Tables):
    index = features.feature_index(t.embeddings, "vec_id", "embedding")
    return index.select(
        F.col("vec_id").alias("id"), F.regexp_extract("location", r"([^/]+)$", 1).alias("file"), "n_frames"
    )


@catalog.add("SELECT source AS speaker, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)")
def load_speaker_ids(t: Tables):
    return vocab.speaker_ids(t.documents.select(F.col("source").alias("speaker")))


SQL_VOCAB_IDS = f"""{C.SQL_BENCH_WORDS},
vocab AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS id FROM words GROUP BY token
  UNION ALL VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3))"""


def benchmark_vocab(t: Tables):
    counts = aggregates.token_vocab(t.benchmark, words(F.col("text")))
    return vocab.vocab_ids(counts, [F.desc("count"), F.col("token")])


@catalog.add(f"WITH {SQL_VOCAB_IDS} SELECT token, id FROM vocab")
def load_vocab_ids(t: Tables):
    return benchmark_vocab(t)
