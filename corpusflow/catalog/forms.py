"""Further forms of operators: small spans, null keys, long forms, reports, files by column name."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.catalog.joins import SQL_REGISTRY, conversation_registry
from corpusflow.functions.text import strip
from corpusflow.operators import alignment, ctc, joins, similarity
from corpusflow.operators.sequences import Sequences, from_rows
from corpusflow.session import scratch_path
from corpusflow.sources import evaluation, lines, manifests, vocab

catalog = Catalog()
SPAN = 8

SQL_SPANNED = """
frames AS (
  SELECT user_id, t, symbol, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t
    FROM (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_id, ts, event_type AS symbol, value FROM events)))"""


def spanned(t: Tables) -> Sequences:
    """Events of a user in time order, in spans of 8; every seventh user's events have no user."""
    user = F.when(F.pmod("user_id", F.lit(7)) != 0, F.col("user_id")).alias("user_id")
    events = t.events.select(user, "event_id", "ts", F.col("event_type").alias("symbol"), "value")
    numbered = from_rows(events, ["user_id"], [F.col("ts"), F.col("event_id")])
    return Sequences(numbered.df, ("user_id",), span=SPAN)


@catalog.add(
    f"""WITH {SQL_SPANNED}
    SELECT user_id, t, (sum(t % 5) OVER w)::BIGINT AS total, lag(symbol, 1, '-') OVER w AS before,
      last_value(CASE WHEN symbol = 'view' THEN t END IGNORE NULLS) OVER w AS seen, count(*) OVER (PARTITION BY user_id) AS n,
      max(CASE WHEN symbol = 'error' THEN t END) OVER (PARTITION BY user_id) AS last_error
    FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def sequence_steps(t: Tables):
    chain = spanned(t).running_sum(F.col("t") % 5, "total").previous(F.col("symbol"), "before", F.lit("-"))
    chain = chain.last_seen(F.when(F.col("symbol") == "view", F.col("t")), "seen")
    facts = chain.attach(n=("sum", F.lit(1)), last_error=("max", F.when(F.col("symbol") == "error", F.col("t"))))
    return facts.df.select("user_id", "t", "total", "before", "seen", "n", "last_error")


SQL_SPANNED_RUNS = f"""{SQL_SPANNED},
marked AS (
  SELECT *, CASE WHEN symbol <> 'view' AND symbol IS DISTINCT FROM lag(symbol) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS opens
  FROM frames),
runs AS (
  SELECT user_id, t, symbol, value, CASE WHEN symbol = 'view' THEN 0 ELSE sum(opens) OVER (PARTITION BY user_id ORDER BY t) END::BIGINT AS run
  FROM marked)"""


@catalog.add(
    f"WITH {SQL_SPANNED_RUNS} SELECT user_id, run - 1 AS pos, min(symbol) AS symbol, min(t) AS start_frame FROM runs WHERE run > 0 GROUP BY user_id, run"
)
def ctc_collapse_in_spans(t: Tables):
    return ctc.ctc_collapse(spanned(t), blank="view").df


@catalog.add(f"WITH {SQL_SPANNED_RUNS} SELECT user_id, run, round(avg(value), 6) AS value FROM runs WHERE run > 0 GROUP BY user_id, run")
def ctc_merge_in_spans(t: Tables):
    merged = ctc.ctc_merge(spanned(t), "meanpool", F.col("value"), blank="view")
    return merged.withColumn("value", F.round("value", 6))


@catalog.add(f"WITH {SQL_SPANNED_RUNS} SELECT user_id, max(run) AS n_labels FROM runs GROUP BY user_id")
def ctc_lengths(t: Tables):
    return ctc.ctc_lengths(spanned(t), blank="view")


SQL_SPANNED_TRIM = f"""{SQL_SPANNED},
said AS (SELECT user_id, t, symbol AS phone, t * 0.7::DOUBLE AS "start", t * 0.7::DOUBLE + (t % 4) AS "end" FROM frames),
longer AS (SELECT *, (round_even("end", 0) - round_even("start", 0))::BIGINT AS duration FROM said),
bounds AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM longer WHERE duration > 0 AND phone NOT IN ('error', 'view') GROUP BY user_id),
kept AS (SELECT l.user_id, phone, duration, "start", "end", row_number() OVER (PARTITION BY l.user_id ORDER BY l.t) - 1 AS pos
  FROM longer l JOIN bounds b ON l.user_id IS NOT DISTINCT FROM b.user_id AND l.t BETWEEN lo AND hi WHERE duration > 0)"""


def _trimmed(t: Tables) -> tuple[Sequences, Sequences]:
    start = F.col("t") * 0.7
    said = spanned(t).select(F.col("symbol").alias("phone"), start.alias("start"), (start + F.col("t") % 4).alias("end"))
    timed = alignment.frame_durations(said, 1.0, 1)
    return said, alignment.trim_silence(timed, silence=("error", "view"))


@catalog.add(
    f"""WITH {SQL_SPANNED_TRIM} SELECT user_id, pos, phone, (sum(duration) OVER w - duration)::BIGINT AS start_frame, (sum(duration) OVER w)::BIGINT AS end_frame
    FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY pos)"""
)
def trim_and_offsets_in_spans(t: Tables):
    return alignment.offsets(_trimmed(t)[1]).df.select("user_id", "pos", "phone", "start_frame", "end_frame")


@catalog.add(
    f"""WITH {SQL_SPANNED_TRIM}, s AS (SELECT user_id, count(*) AS n, sum(duration)::BIGINT AS f, min("start") AS a, max("end") AS b
      FROM kept GROUP BY user_id),
    ends AS (SELECT k.user_id, min(CASE WHEN phone NOT IN ('error', 'view') THEN "start" END) AS a, max(CASE WHEN phone NOT IN ('error', 'view') THEN "end" END) AS b
      FROM kept k GROUP BY k.user_id),
    u AS (SELECT DISTINCT user_id FROM frames)
    SELECT u.user_id, coalesce(n, 0) AS n_tokens, coalesce(f, 0) AS n_frames, round(coalesce(ends.a, 0), 6) AS start_sec, round(coalesce(ends.b, 0), 6) AS end_sec,
      n IS NULL AS all_silent
    FROM u LEFT JOIN s ON u.user_id IS NOT DISTINCT FROM s.user_id LEFT JOIN ends ON u.user_id IS NOT DISTINCT FROM ends.user_id"""
)
def trimmed_samples(t: Tables):
    said, trimmed = _trimmed(t)
    report = alignment.trimmed_samples(said.df, trimmed)
    return report.withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


@catalog.add(
    f"""WITH {SQL_SPANNED},
    segments AS (SELECT user_id, t AS seg, end_frame - len AS start_frame, end_frame FROM (
      SELECT user_id, t, (t % 3) AS len, sum(t % 3) OVER (PARTITION BY user_id ORDER BY t) AS end_frame FROM frames))
    SELECT s.user_id, s.seg, round(coalesce(avg(value), 0), 6) AS mean, count(value)::BIGINT AS n_frames
    FROM segments s LEFT JOIN frames f ON f.user_id IS NOT DISTINCT FROM s.user_id AND f.t >= s.start_frame AND f.t < s.end_frame
    GROUP BY s.user_id, s.seg"""
)
def segment_mean_in_spans(t: Tables):
    frames = spanned(t)
    placed = alignment.offsets(frames.select((F.col("t") % 3).alias("duration"))).df
    segments = placed.select("user_id", F.col("t").alias("seg"), "start_frame", "end_frame")
    return alignment.segment_mean(frames, segments, "value").withColumn("mean", F.round("mean", 6))


SQL_TRUE_LENGTHS = f"""{SQL_SPANNED},
cut AS (SELECT user_id, t, CASE WHEN t < n * (coalesce(user_id, 1) % 4) // 4 THEN value ELSE 0 END AS value, n * (coalesce(user_id, 1) % 4) // 4 AS length
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM frames) WHERE t < greatest(n * (coalesce(user_id, 1) % 4) // 4, 1))"""


def unpadded(t: Tables) -> Sequences:
    """Frames up to a share of each user's own number of them; a share of none leaves a zero frame."""
    whole = spanned(t).attach(n=("sum", F.lit(1)))
    length = F.floor(F.col("n") * (F.coalesce("user_id", F.lit(1)) % 4) / 4)
    return ctc.unpad(whole, length, "value").drop("n")


@catalog.add(f"WITH {SQL_TRUE_LENGTHS} SELECT user_id, t, round(value, 6) AS value FROM cut")
def unpad_long_frames(t: Tables):
    return unpadded(t).df.select("user_id", "t", F.round("value", 6).alias("value"))


@catalog.add(
    f"""WITH {SQL_TRUE_LENGTHS}
    SELECT user_id, t // 3 AS frame, string_agg(round(value, 4)::VARCHAR, ' ' ORDER BY t) AS packed FROM cut
    GROUP BY user_id, t // 3 HAVING count(*) = 3"""
)
def pack_long_frames(t: Tables):
    """Padded sequences cut to their true lengths, then stacked three by three."""
    packed = ctc.pack_long_frames(unpadded(t).with_columns({"value": F.round("value", 4)}), "value", 3)
    return packed.select("user_id", "frame", C.joined(F.col("value")).alias("packed"))


@catalog.add(
    """WITH p AS (SELECT doc_id AS idx, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS plain,
        CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 15 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 11 = 1 THEN 1 ELSE 0 END AS spoken
      FROM documents WHERE doc_id % 9 <> 4)
    SELECT idx, 'several speaker variants' AS problem FROM p WHERE plain = 0 AND spoken > 1
    UNION ALL SELECT idx, 'speaker variant beside the plain file' FROM p WHERE plain = 1 AND spoken > 0
    UNION ALL SELECT idx, 'gap before this index' FROM p WHERE idx > 0 AND idx - 1 NOT IN (SELECT idx FROM p)"""
)
def prediction_problems(t: Tables):
    i = F.col("doc_id")
    names = F.array_compact(
        F.array(
            F.when(i % 5 == 0, F.lit("_spk7")).otherwise(F.lit("")),
            F.when(i % 15 == 0, F.lit("_spk8")),
            F.when(i % 11 == 1, F.lit("_spk9")),
        )
    )
    files = t.documents.filter(i % 9 != 4).select("doc_id", F.explode(names).alias("n"))
    return evaluation.prediction_problems(files.select(F.concat(F.lit("w/"), F.col("doc_id").cast("string"), "n", F.lit("_pred.wav")).alias("path")))


@catalog.add(
    f"""WITH {SQL_REGISTRY} SELECT d.doc_id || '.mp3' AS id FROM documents d
    WHERE d.doc_id::VARCHAR NOT IN (SELECT id FROM registry WHERE src_audio IS NOT NULL AND tgt_audio IS NOT NULL)"""
)
def missing_from_registry(t: Tables):
    """Samples of an s2s manifest with a target that lack one side or both."""
    manifest = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".mp3")).alias("id"), F.lit(None).cast("string").alias("tgt_audio"))
    return joins.missing_from_registry(manifest, conversation_registry(t), "s2s").select("id")


@catalog.add(
    f"""WITH {SQL_REGISTRY} SELECT r.id || '.mp3' AS id, src_audio, src_n_frames, tgt_audio, tgt_n_frames, pitch, energy
    FROM registry r WHERE src_audio IS NOT NULL AND tgt_audio IS NOT NULL"""
)
def manifest_fill_both_sides(t: Tables):
    registry = conversation_registry(t)
    both = registry.filter(F.col("src_audio").isNotNull() & F.col("tgt_audio").isNotNull())
    manifest = both.select(F.concat("id", F.lit(".mp3")).alias("id"), F.lit("").alias("tgt_audio"))
    return joins.fill_manifest(manifest, registry, "s2s")


@catalog.add(
    f"""WITH {C.SQL_PAIRS.replace('pairs AS', 'p AS')},
    l AS (SELECT a.pos // 16 AS batch, a.pos % 16 AS i, b.pos % 16 AS j,
        -list_sum(list_transform(list_zip(a.x, b.y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 0.1 AS l
      FROM p a JOIN p b ON a.pos // 16 = b.pos // 16),
    s AS (SELECT batch, i, j, l, max(l) OVER r AS mr, max(l) OVER c AS mc FROM l
      WINDOW r AS (PARTITION BY batch, i), c AS (PARTITION BY batch, j)),
    e AS (SELECT i, j, l, mr + ln(sum(exp(l - mr)) OVER (PARTITION BY batch, i)) AS lr,
        mc + ln(sum(exp(l - mc)) OVER (PARTITION BY batch, j)) AS lc FROM s)
    SELECT count(*)::BIGINT AS n_rows, round(-0.5 * avg(l - lr + l - lc), 5) AS score FROM e WHERE i = j"""
)
def contrastive_score_of_all(t: Tables):
    even, odd = C.even_odd(t)
    pairs = similarity.pair_similarity(even, odd, "l1", batch_rows=16)
    return similarity.contrastive_score(pairs, temperature=0.1).withColumn("score", F.round("score", 5))


@catalog.add(
    f"""SELECT doc_id, lang, {C.sql_one_line('text')} AS text, CASE WHEN doc_id % 2 = 0 THEN 'nobody' ELSE source END AS speaker FROM documents"""
)
def manifests_by_header_name(t: Tables):
    """Two manifests with different column orders; one of them has no speaker."""
    path = scratch_path(t.spark, "named")
    rows = t.documents.select("doc_id", "lang", C.one_line(F.col("text")).alias("text"), F.col("source").alias("speaker"))
    manifests.write_manifest(rows.filter("doc_id % 2 = 0"), f"{path}/even", ["text", "doc_id", "lang"], by=())
    manifests.write_manifest(rows.filter("doc_id % 2 = 1"), f"{path}/odd", ["lang", "speaker", "doc_id", "text"], by=())
    read = manifests.read_manifest_tsv(t.spark, [f"{path}/even", f"{path}/odd"], ["doc_id", "lang", "text"], {"speaker": "nobody"})
    return read.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.coalesce("text", F.lit(""))})


@catalog.add(
    """SELECT n_chars % 3 = 0 AS rejected, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM
      (SELECT n_chars, CASE WHEN n_chars % 3 = 0 THEN text || chr(9) ELSE regexp_replace(text, '[\t\n\r]+', ' ', 'g') END AS text FROM documents) GROUP BY 1"""
)
def rows_set_aside(t: Tables):
    """Rows whose text the format cannot hold are set aside; the others come back whole."""
    text = F.when(F.col("n_chars") % 3 == 0, F.concat("text", F.lit("\t"))).otherwise(C.one_line(F.col("text")))
    good, bad = manifests.split_tsv_safe(t.documents.select("doc_id", text.alias("text")))
    path = scratch_path(t.spark, "safe")
    manifests.write_manifest(good, path, ["doc_id", "text"], by=())
    back = manifests.read_manifest_tsv(t.spark, path, ["text", "doc_id"])
    sized = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).select(F.lit(flag).alias("rejected"), "n", "chars")
    return sized(back, False).unionAll(sized(bad, True)).filter("n > 0")


@catalog.add(f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, {C.sql_strip(C.sql_one_line('text'))} AS text FROM benchmark")
def read_reference_tsv(t: Tables):
    """A named column of a reference in TSV form, by line over all its part files."""
    path = scratch_path(t.spark, "reference")
    rows = t.benchmark.select("item_id", C.one_line(F.col("text")).alias("tgt_text")).repartitionByRange("item_id").sortWithinPartitions("item_id")
    manifests.write_manifest(rows, path, ["item_id", "tgt_text"], by=())
    return lines.read_reference_tsv(t.spark, path, "tgt_text").withColumn("text", strip(F.col("text")))


@catalog.add("SELECT row_number() OVER (ORDER BY source) - 1 AS line_no, source AS token FROM (SELECT DISTINCT source FROM documents)")
def speaker_list(t: Tables):
    """Written in order, read back with its position over all part files."""
    path = scratch_path(t.spark, "speakers")
    vocab.write_speakers(t.documents.select(F.col("source").alias("speaker")), path)
    return lines.read_token_list(t.spark, path)
