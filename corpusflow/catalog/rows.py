"""Filters, defaults and per-row columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.functions import arrays as A
from corpusflow.functions import text as X
from corpusflow.operators import filters
from corpusflow.operators.unions import stack_rows

catalog = Catalog()


@catalog.add("SELECT doc_id, doc_id || '-' || lang AS id FROM documents")
def normalize_sample_id(t: Tables):
    raw = F.concat(F.col("doc_id").cast("string"), F.lit(".mp3-"), F.col("lang"), F.lit(".mp3"))
    return t.documents.select("doc_id", X.normalize_id(raw).alias("id"))


@catalog.add(f"SELECT doc_id, split FROM (SELECT doc_id, {C.sql_split('doc_id')} AS split FROM documents) WHERE split IN ('train', 'train_covost')")
def select_split(t: Tables):
    tagged = t.documents.select("doc_id", C.split_of(F.col("doc_id")).alias("split"))
    return filters.select_split(tagged, "train")


@catalog.add(
    """SELECT lang AS src_lang, tgt AS tgt_lang, count(*)::BIGINT AS n_rows
    FROM documents, unnest(['en', 'de', 'fr', 'xx', 'sv-SE']) u(tgt)
    WHERE (tgt = 'en' AND lang IN ('fr','de','es','ca','it','ru','zh-CN','pt','fa','et','mn','nl','tr','ar','sv-SE','lv','sl','ta','ja','id','cy'))
       OR (lang = 'en' AND tgt IN ('de','tr','fa','sv-SE','mn','zh-CN','cy','ca','sl','et','id','ar','ta','lv','ja'))
    GROUP BY lang, tgt"""
)
def valid_direction(t: Tables):
    targets = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "xx", "sv-SE")]))
    paired = t.documents.select(F.col("lang").alias("src_lang"), targets.alias("tgt_lang"))
    return filters.valid_direction(paired).groupBy("src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("n_rows"))


@catalog.add(
    r"""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'undecodable' END AS reason,
    CASE WHEN user_id % 5 <> 0 THEN regexp_extract(props, '(\d+)', 1)::BIGINT END AS k FROM events"""
)
def drop_undecodable(t: Tables):
    # Records of some users are cut short, as a damaged file would be.
    cut = F.when(F.col("user_id") % 5 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    records = t.events.select("event_id", cut.alias("record"))
    probe = F.from_json("record", "k bigint")["k"]
    good, bad = filters.drop_undecodable(records, probe)
    good = good.select("event_id", F.lit(None).cast("string").alias("reason"), probe.alias("k"))
    return stack_rows(good, bad.select("event_id", "reason", F.lit(None).cast("bigint").alias("k")))


@catalog.add(
    """SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, '' AS tgt_text, lang FROM documents LEFT JOIN labels USING (doc_id)"""
)
def optional_defaults(t: Tables):
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    full = filters.with_optional(joined, {"quality": -1, "tgt_text": "", "lang": "en"})
    return full.select("doc_id", F.col("quality").cast("bigint").alias("quality"), "tgt_text", "lang")


@catalog.add(
    """WITH j AS (SELECT doc_id, lang, n_chars, CASE WHEN lang = 'en' THEN coalesce(quality, 0) ELSE quality END AS pitch
      FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, lang, CASE WHEN count(n_chars) OVER w = count(*) OVER w THEN n_chars END AS duration,
      CASE WHEN count(pitch) OVER w = count(*) OVER w THEN pitch END::BIGINT AS pitch
    FROM j WINDOW w AS (PARTITION BY lang)"""
)
def all_or_nothing_column(t: Tables):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    pitch = F.when(F.col("lang") == "en", F.coalesce("quality", F.lit(0))).otherwise(F.col("quality"))
    sides = joined.select("doc_id", "lang", F.col("n_chars").alias("duration"), pitch.cast("bigint").alias("pitch"))
    return filters.all_or_nothing(sides, ["duration", "pitch"], by="lang")


def _word_lengths():
    return F.transform(X.words(F.col("text")), lambda w: F.length(w))


@catalog.add(
    f"""WITH {C.SQL_BENCH_WORDS}
    SELECT item_id, count(*)::BIGINT AS n, sum(duration)::BIGINT AS total, max(duration)::BIGINT AS longest FROM words GROUP BY item_id"""
)
def parse_durations(t: Tables):
    written = t.benchmark.select("item_id", A.format_durations(_word_lengths()).alias("duration"))
    parsed = written.select("item_id", A.parse_durations(F.col("duration")).alias("d"))
    return parsed.select(
        "item_id",
        F.size("d").cast("bigint").alias("n"),
        A.array_sum(F.col("d")).alias("total"),
        F.array_max("d").cast("bigint").alias("longest"),
    )


@catalog.add(
    """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN '/abs/' || page_id ELSE 'data/root/' || page_id || '.npy' END AS path FROM pages"""
)
def resolve_path(t: Tables):
    page = F.col("page_id").cast("string")
    relative = F.when(F.col("url").contains("/en/"), F.concat(F.lit("/abs/"), page)).otherwise(F.concat(page, F.lit(".npy")))
    return t.pages.select("page_id", filters.resolve_path("data/root", relative).alias("path"))


@catalog.add(
    f"""WITH d AS (SELECT doc_id, n_chars, len({C.sql_words('text')})::BIGINT AS n_words,
        CASE WHEN lang = 'en' THEN 'st' WHEN lang = 'fr' THEN 's2st' ELSE 'tts' END AS task FROM documents)
    SELECT doc_id, task, n_chars <= CASE WHEN task = 'tts' THEN 1024 ELSE 6000 END
        AND n_words <= CASE WHEN task = 'st' THEN 1024 ELSE 1200 END AS kept FROM d"""
)
def max_positions_filter(t: Tables):
    task = F.when(F.col("lang") == "en", "st").when(F.col("lang") == "fr", "s2st").otherwise("tts")
    sized = t.documents.select("doc_id", "n_chars", F.size(X.words(F.col("text"))).alias("n_words"), task.alias("task"))
    kept, rejected = filters.max_positions_filter(sized, "n_chars", "n_words", F.col("task"))
    tag = lambda df, flag: df.select("doc_id", "task", F.lit(flag).alias("kept"))
    return stack_rows(tag(kept, True), tag(rejected, False))


@catalog.add(
    """WITH b AS (SELECT vec_id, embedding, trunc(label * 0.3::DOUBLE * 16)::INT AS lo,
        trunc((label * 0.3::DOUBLE + 1.7::DOUBLE) * 16)::INT AS hi FROM embeddings),
    c AS (SELECT vec_id, list_slice(embedding, lo + 1, hi) AS s FROM b)
    SELECT vec_id, len(s)::BIGINT AS n, round(list_sum(list_transform(s, lambda x: x::DOUBLE)), 6) AS total FROM c"""
)
def segment_crop(t: Tables):
    start = F.col("label") * F.lit(0.3)
    cut = A.crop(F.col("embedding"), start, start + 1.7, 16.0)
    return t.embeddings.select("vec_id", cut.alias("s")).select(
        "vec_id", F.size("s").cast("bigint").alias("n"), C.r6(A.array_sum(F.col("s"), "double"), "total")
    )
