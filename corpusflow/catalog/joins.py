"""Joins of corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.catalog.io import SQL_VOCAB_IDS, benchmark_vocab
from corpusflow.functions.text import words
from corpusflow.operators import joins, similarity
from corpusflow.operators.alignment import frames_to_segments
from corpusflow.operators.sequences import exploded
from corpusflow.operators.unions import stack_rows

catalog = Catalog()


@catalog.add(
    f"""SELECT d.doc_id::VARCHAR AS path, text AS sentence, source AS client_id, quality::VARCHAR AS translation, {C.sql_split('d.doc_id')} AS split
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def transcript_translation_join(t: Tables):
    path = F.col("doc_id").cast("string").alias("path")
    transcripts = t.documents.select(path, F.col("text").alias("sentence"), F.col("source").alias("client_id"), "lang")
    translations = t.labels.select(
        path, F.col("quality").cast("string").alias("translation"), C.split_of(F.col("doc_id")).alias("split"), "toxic"
    )
    return joins.join_translations(transcripts, translations)


@catalog.add(
    """SELECT f.conv_id AS path, f.role AS sentence, l.text AS translation
    FROM (SELECT conv_id, role FROM conversations WHERE turn = 0) f
    JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) l USING (conv_id)"""
)
def target_override_join(t: Tables):
    turns = t.conversations
    first = turns.filter("turn = 0").select(
        F.col("conv_id").alias("path"), F.col("role").alias("sentence"), F.col("text").alias("translation")
    )
    target = turns.select(F.col("conv_id").alias("path"), "text", F.col("turn").alias("line_no"))
    return joins.override_target(first, target)


@catalog.add("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def require_alignment(t: Tables):
    return joins.require_alignment(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@catalog.add("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_alignment_report(t: Tables):
    return joins.missing_alignment(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@catalog.add(
    """SELECT o_orderkey AS id, o_orderstatus AS status, n_frames, pitch, energy
    FROM orders
    JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n_frames FROM lineitem GROUP BY 1) a ON l_orderkey = o_orderkey
    JOIN (SELECT o_orderkey AS pk, c_acctbal AS pitch FROM orders JOIN customer ON o_custkey = c_custkey) p ON pk = o_orderkey
    JOIN (SELECT l_orderkey AS ek, max(p_size)::BIGINT AS energy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) e ON ek = o_orderkey"""
)
def feature_intersection(t: Tables):
    orders = t.orders
    audio = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("bigint").alias("n_frames"))
    pitch = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_acctbal").alias("pitch")
    )
    energy = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.max("p_size").cast("bigint").alias("energy"))
    )
    samples = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return joins.complete_features(samples, {"audio": audio, "pitch": pitch, "energy": energy})


def conversation_registry(t: Tables):
    source = t.conversations.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".mp3")).alias("id"),
        F.concat_ws("/", "role", F.col("turn").cast("string")).alias("src_audio"),
        F.length("text").cast("bigint").alias("src_n_frames"),
        F.col("turn").alias("priority"),
    )
    target = t.labels.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tgt_audio"),
        (F.col("doc_id") % 100).alias("tgt_n_frames"),
        F.col("quality").cast("bigint").alias("pitch"),
        F.col("toxic").cast("bigint").alias("energy"),
        F.lit(0).alias("priority"),
    )
    return joins.merge_registry(source, target)


SQL_REGISTRY = """
src AS (
  SELECT conv_id::VARCHAR AS id, arg_max(role || '/' || turn, turn) AS src_audio,
         arg_max(length(text), turn)::BIGINT AS src_n_frames, count(*)::BIGINT AS n_source
  FROM conversations GROUP BY conv_id),
registry AS (
  SELECT coalesce(src.id, doc_id::VARCHAR) AS id, src_audio, src_n_frames, coalesce(n_source, 0) AS n_source,
         'q' || quality AS tgt_audio, doc_id % 100 AS tgt_n_frames, quality::BIGINT AS pitch, toxic::BIGINT AS energy,
         CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_target
  FROM src FULL OUTER JOIN labels ON src.id = doc_id::VARCHAR)"""


@catalog.add(f"WITH {SQL_REGISTRY} SELECT * FROM registry")
def registry_merge(t: Tables):
    return conversation_registry(t)


@catalog.add(
    f"""WITH {SQL_REGISTRY}
    SELECT doc_id || '.mp3' AS id, r.tgt_audio AS audio, r.tgt_n_frames AS n_frames, r.pitch, r.energy
    FROM labels l JOIN registry r ON r.id = l.doc_id::VARCHAR"""
)
def manifest_fill(t: Tables):
    manifest = t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".mp3")).alias("id"))
    return joins.fill_manifest(manifest, conversation_registry(t), "tts")


@catalog.add(
    """SELECT coalesce(p.item_id, r.item_id + 1) AS idx, p.text AS prediction, r.text AS reference,
      CASE WHEN r.item_id IS NULL THEN 'prediction' WHEN p.item_id IS NULL THEN 'reference' END AS only_in
    FROM benchmark p FULL OUTER JOIN benchmark r ON p.item_id = r.item_id + 1"""
)
def positional_align(t: Tables):
    predictions = t.benchmark.select(F.col("item_id").alias("idx"), F.col("text").alias("prediction"))
    references = t.benchmark.select((F.col("item_id") + 1).alias("idx"), F.col("text").alias("reference"))
    paired = joins.align_by_position(predictions, references)
    stray = joins.unpaired_positions(predictions, references)
    stray = stray.join(predictions, "idx", "left").join(references, "idx", "left")
    return stack_rows(paired, stray)


@catalog.add(
    f"""SELECT d.doc_id, source, quality::BIGINT AS phoneme, n_turns AS unigram
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    LEFT JOIN (SELECT conv_id, count(*)::BIGINT AS n_turns FROM conversations GROUP BY 1) c ON conv_id = d.doc_id"""
)
def multitask_lookup(t: Tables):
    phoneme = t.labels.select("doc_id", F.col("quality").cast("bigint").alias("target"))
    unigram = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("target"))
    full = joins.attach_targets(t.documents.select("doc_id", "source"), {"phoneme": phoneme, "unigram": unigram}, "doc_id")
    return full.select("doc_id", "source", "multitask.phoneme", "multitask.unigram")


_SQL_EMPTIED = "CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN '' ELSE text END"


@catalog.add(
    f"""WITH {SQL_VOCAB_IDS},
    tok AS (SELECT conv_id, turn, i, w[i] AS token
      FROM (SELECT conv_id, turn, {C.sql_words(_SQL_EMPTIED)} AS w FROM conversations) c, unnest(generate_series(1, len(w))) u(i)),
    e AS (SELECT conv_id, turn, string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY i) || ' 2' AS ids,
        count(*)::BIGINT AS n_tokens, (count(*) - count(id))::BIGINT AS n_oov
      FROM tok LEFT JOIN vocab USING (token) GROUP BY conv_id, turn)
    SELECT conv_id, turn, coalesce(ids, '2') AS ids, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_oov, 0) AS n_oov
    FROM conversations LEFT JOIN e USING (conv_id, turn)"""
)
def encode_tokens(t: Tables):
    """Every third first turn is emptied: a sample without tokens still gets its end symbol."""
    encoded = _encoded(t)
    return encoded.withColumn("ids", C.joined(F.col("ids")))


def _encoded(t: Tables):
    key = ["conv_id", "turn"]
    text = F.when((F.col("turn") == 0) & (F.pmod("conv_id", F.lit(3)) == 0), F.lit("")).otherwise(F.col("text"))
    samples = t.conversations.select(*key, text.alias("text")).repartition(*key)
    return joins.encode_tokens(exploded(samples, key, token=words(F.col("text"))), benchmark_vocab(t), samples)


@catalog.add(
    f"""WITH {SQL_VOCAB_IDS},
    tok AS (SELECT conv_id, turn, i, w[i] AS token
      FROM (SELECT conv_id, turn, {C.sql_words(_SQL_EMPTIED)} AS w FROM conversations) c, unnest(generate_series(1, len(w))) u(i)),
    e AS (SELECT conv_id, turn, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE token END, ' ' ORDER BY i) || ' </s>' AS symbols
      FROM tok LEFT JOIN vocab USING (token) GROUP BY conv_id, turn)
    SELECT conv_id, turn, coalesce(symbols, '</s>') AS symbols FROM conversations LEFT JOIN e USING (conv_id, turn)"""
)
def ids_to_symbols(t: Tables):
    key = ["conv_id", "turn"]
    back = joins.decode_ids(_encoded(t), benchmark_vocab(t), key=key)
    return back.select(*key, F.array_join("symbols", " ").alias("symbols"))


@catalog.add(
    f"""WITH {C.SQL_PAIRS.replace('pairs AS', 'p AS')},
    j AS (SELECT a.pos // 16 AS batch, a.pos % 16 AS i, b.pos % 16 AS j,
        list_transform(a.x, lambda v: v::DOUBLE) AS x, list_transform(b.y, lambda v: v::DOUBLE) AS y
      FROM p a JOIN p b ON a.pos // 16 = b.pos // 16),
    d AS (SELECT *, list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])) AS diff FROM j)
    SELECT batch, i, j, m AS metric, round(CASE m
        WHEN 'cosine' THEN list_inner_product(x, y) / (greatest(sqrt(list_inner_product(x, x)), 1e-8) * greatest(sqrt(list_inner_product(y, y)), 1e-8))
        WHEN 'dot' THEN list_inner_product(x, y)
        WHEN 'l1' THEN -list_sum(diff)
        WHEN 'l2' THEN -list_sum(list_transform(diff, lambda v: v * v))
        ELSE -list_sum(list_transform(diff, lambda v: CASE WHEN v < 1 THEN 0.5 * v * v ELSE v - 0.5 END)) END, 6) AS similarity
    FROM d, unnest(['cosine', 'l1', 'l2', 'smoothl1', 'dot']) u(m)"""
)
def batch_pair_similarity(t: Tables):
    even, odd = C.even_odd(t)
    pairs = similarity.pair_similarity(even, odd, *similarity.METRICS, batch_rows=16)
    return pairs.unpivot(["batch", "i", "j"], list(similarity.METRICS), "metric", "similarity").withColumn(
        "similarity", F.round("similarity", 6)
    )


@catalog.add(
    f"""WITH {C.SQL_SEGMENTS}
    SELECT f.user_id, f.t, s.seg, f.value FROM frames f JOIN segments s
      ON f.user_id = s.user_id AND f.t >= s.start_frame AND f.t < s.end_frame"""
)
def segment_frame_join(t: Tables):
    frames, segments = C.user_segments(t)
    kept = frames.with_df(frames.df.select("user_id", "t", "value"))
    return frames_to_segments(kept, segments)
