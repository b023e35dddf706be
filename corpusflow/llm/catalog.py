"""The operators of this package bound to the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog import Catalog
from corpusflow.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    hard_negatives,
    license_scan,
    lm_score,
    nbsvm,
    ngram_join,
    quality_rules,
    sequence_packing,
    shard_packing,
    warc_store,
    whitening,
)
from corpusflow.session import scratch_path, written

catalog = Catalog()
SHARDS = 24


@catalog.add(
    r"""
    WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    r AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                 min(page_id) OVER (PARTITION BY html) AS first_id FROM t)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM r
    """,
)
def op3_warc_store(t) -> DataFrame:
    """Archive all pages, write a WARC record for each, read the files back, and report what their records say."""
    folder = scratch_path(t.spark, "warc")
    warc_store.archive(t.pages, folder)
    warc_store.export_warc(t.spark, folder, f"{folder}/files")
    return warc_store.described_files(t.spark, f"{folder}/files")


@catalog.add()
def op4_shard_packing(t) -> DataFrame:
    """All documents in 24 shards of near equal bytes; copies of a text share their shard."""
    return shard_packing.shard_by_bytes(t.documents, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@catalog.add(
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
    g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
    """,
)
def op9_exact_dedup(t) -> DataFrame:
    """The older half of the ids is the archive; the newer half is looked up in it."""
    rows = t.documents.select("doc_id", exact_dedup.text_digest("text").alias("digest"))
    return exact_dedup.group_rows(*exact_dedup.by_age(rows)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"


@catalog.add(
    rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, w[s : s + least(len(w), 10) - 1] AS gram
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(gram) AS k FROM win),
    g AS (SELECT doc_id, k, s, w[s : s + k - 1] AS gram
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)),
    h AS (SELECT doc_id, k, s, item_id FROM g JOIN win USING (gram)),
    p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS pos FROM h) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
)
def op5_decontaminate(t) -> DataFrame:
    """All documents against the whole benchmark."""
    return decontaminate.scan(t.documents, t.benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.tiktoken", 50_256


@catalog.add()
def op7_bpe(t) -> DataFrame:
    """Every whole text to ids and back."""
    path = public_tokenizers.path(WORD_BPE)
    rows = bpe.decode(bpe.encode(t.documents.select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@catalog.add()
def op8_quality_classifier(t) -> DataFrame:
    """The quality score of every document, learnt from the labelled rows that are not held out."""
    model = nbsvm.fit(t.documents, t.labels)
    return nbsvm.score(t.documents.select("doc_id", "text"), model).select(
        "doc_id", nbsvm.held_out().alias("held_out"), "score", (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted")
    )


@catalog.add()
def op10_sequence_packing(t) -> DataFrame:
    """All documents as rows of 2,048 token ids, written as a table and read back."""
    packed = sequence_packing.pack(t.documents, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, BYTE_BPE_END)
    return written(packed, "packed").select(
        "pack_id", "doc_ids", "pieces", "cu_seqlens", "resets", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")
    )


@catalog.add(
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 4], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS j FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
    r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
    k AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
    l AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT y.w) FILTER (WHERE x.w <> y.w) AS n_text_links
          FROM e JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b GROUP BY a)
    SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links,
           CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w) END AS n_copies
    FROM d JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
)
def op1_ngram_join(t) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 on five-word n-grams."""
    return ngram_join.join(t.documents).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


_NOTICE_WORDS = ", ".join(
    f"({i}, '{name}', {license_scan.template_words(text)!r})" for i, (name, text) in enumerate(license_scan.NOTICES)
)


@catalog.add(
    rf"""
    WITH t AS (SELECT template, license, w, len(w) AS l, greatest(1, len(w) // 4) AS s FROM (VALUES {_NOTICE_WORDS}) AS v(template, license, w)),
    ts AS (SELECT DISTINCT template, license, l, s, array_to_string(w[j : j + 4], ' ') AS shingle
           FROM (SELECT *, unnest(generate_series(1, l - 4)) AS j FROM t)),
    n AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, j - 1 AS p, array_to_string(w[j : j + 4], ' ') AS shingle
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS j FROM d WHERE len(w) >= 5)),
    h AS (SELECT doc_id, template, license, l, s, p, shingle FROM g JOIN ts USING (shingle)),
    win AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((p - (l + s - 4) + 1) / s) AS BIGINT)), p // s)) * s AS start FROM h),
    c AS (SELECT doc_id, template, license, start, count(DISTINCT shingle) / any_value(n) AS containment
          FROM win JOIN n USING (template) GROUP BY doc_id, template, license, start)
    SELECT doc_id, template, license, max(containment) AS containment, min(CAST(start AS INT)) AS start
    FROM c WHERE containment >= 0.8 GROUP BY doc_id, template, license
    """,
)
def op2_license_scan(t) -> DataFrame:
    """The licences that each document names or holds: notices, whole texts and standard headers."""
    return license_scan.identify(t.documents).drop("text_key")


_SQL_MODEL = """
    {m}3 AS (SELECT a, b, c, count(*) * (SELECT least(t, b) / greatest({side}, 1) FROM sizes) AS n FROM g JOIN {side}_ids USING (doc_id) GROUP BY a, b, c),
    {m}2 AS (SELECT b, c, sum(n) AS n FROM {m}3 GROUP BY b, c),
    {m}1 AS (SELECT c, sum(n) AS n FROM {m}3 GROUP BY c),
    {m}ab AS (SELECT a, b, sum(n) AS n FROM {m}3 GROUP BY a, b),
    {m}b AS (SELECT b, sum(n) AS n FROM {m}3 GROUP BY b),
    {m}p1 AS (SELECT c, (coalesce(n, 0) + 1) / ((SELECT least(t, b) + symbols FROM sizes)) AS p FROM (SELECT DISTINCT c FROM g) LEFT JOIN {m}1 USING (c)),
    {m}p2 AS (SELECT b, c, (coalesce({m}2.n, 0) + 10 * p) / (coalesce({m}b.n, 0) + 10) AS p
              FROM (SELECT DISTINCT b, c FROM g) JOIN {m}p1 USING (c) LEFT JOIN {m}2 USING (b, c) LEFT JOIN {m}b USING (b)),
    {m} AS (SELECT a, b, c, -ln((coalesce({m}3.n, 0) + 10 * p) / (coalesce({m}ab.n, 0) + 10)) AS loss
            FROM (SELECT DISTINCT a, b, c FROM g) JOIN {m}p2 USING (b, c) LEFT JOIN {m}3 USING (a, b, c) LEFT JOIN {m}ab USING (a, b))"""


@catalog.add(
    f"""
    WITH w AS (SELECT doc_id, list_concat(['', ''], CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, '') END, ['']) AS w FROM documents),
    g AS MATERIALIZED (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
    t_ids AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
    b_ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t_ids)),
    sizes AS MATERIALIZED (SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM t_ids))::DOUBLE AS t, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM t_ids))::DOUBLE AS b,
        greatest(128, count(DISTINCT c) FILTER (c <> '') + 2) AS symbols FROM g),{_SQL_MODEL.format(m="ours", side="t")},{_SQL_MODEL.format(m="theirs", side="b")}
    SELECT doc_id, count(*) AS n_tokens, round(avg(ours.loss), 6) AS target_loss, round(avg(theirs.loss), 6) AS background_loss,
           round(avg(ours.loss) - avg(theirs.loss), 6) AS score
    FROM g JOIN ours USING (a, b, c) JOIN theirs USING (a, b, c) GROUP BY doc_id
    """,
)
def op6_lm_score(t) -> DataFrame:
    """Every document between a model of the documents labelled good and a model of all others, matched in size."""
    good = t.labels.filter("quality = 1").select("doc_id").distinct()
    model = lm_score.fit(t.documents, good)
    scored = lm_score.score(t.documents.select("doc_id", "text"), *model).drop("text")
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


_SQL_VECTORS = """
    v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)"""


@catalog.add(
    f"""
    WITH {_SQL_VECTORS},
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, rank::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM (
      SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    WHERE rank <= 5
    """,
)
def op11_hard_negatives(t) -> DataFrame:
    """The hard negatives of every anchor: rows whose id is divisible by 100 against all rows."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(t.embeddings, moved, F.col("vec_id") % 100 == 0)


@catalog.add(
    r"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '[^ 	-
]+') AS w FROM d),
    g AS (SELECT doc_id, j, w[j : j + 7] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS j FROM w WHERE len(w) >= 8)),
    r AS (SELECT doc_id, j FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(j, j + 7)) AS p FROM r) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
    m AS MATERIALIZED (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
            len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
          FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
    v AS (SELECT doc_id, lang, source, unnest([{'m': 'word_length', 'v': 100 * word_chars // n_words}, {'m': 'symbols', 'v': 10000 * n_symbols // n_words},
            {'m': 'dup_lines', 'v': 10000 * n_dup_lines // n_lines}, {'m': 'repeats', 'v': 10000 * n_repeat_words // n_words}], recursive := true) FROM m WHERE NOT base_failed),
    s AS (SELECT lang, source, m, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low, count(*) AS n FROM v GROUP BY ALL),
    s3 AS (SELECT 3 AS level, lang, source, m, low, n FROM s
           UNION ALL SELECT 2, lang, NULL, m, low, sum(n) FROM s GROUP BY lang, m, low UNION ALL SELECT 1, NULL, NULL, m, low, sum(n) FROM s GROUP BY m, low),
    c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM s3),
    q AS (SELECT level, lang, source, m, any_value(total) AS total, min(low) FILTER (4 * upto >= total) AS q1, min(low) FILTER (4 * upto >= 3 * total) AS q3
          FROM c GROUP BY level, lang, source, m),
    f AS (SELECT k.lang, k.source, k.m, q1, q3, CASE m WHEN 'word_length' THEN 100 WHEN 'symbols' THEN 500 WHEN 'dup_lines' THEN 1500 ELSE 1000 END AS slack
          FROM (SELECT DISTINCT lang, source, m FROM s) k JOIN q USING (m)
          WHERE (level = 1 OR total >= 200) AND (level < 2 OR q.lang IS NOT DISTINCT FROM k.lang) AND (level < 3 OR q.source IS NOT DISTINCT FROM k.source)
          QUALIFY row_number() OVER (PARTITION BY k.lang, k.source, k.m ORDER BY level DESC) = 1),
    b AS (SELECT v.doc_id, bool_and(v <= q3 + 3 * (q3 - q1 + slack) AND (v.m <> 'word_length' OR v >= q1 - 3 * (q3 - q1 + slack))) AS ok
          FROM v JOIN f ON v.m = f.m AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source GROUP BY v.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, FALSE) AS kept
    FROM m LEFT JOIN b USING (doc_id)
    """,
)
def op12_quality_rules(t) -> DataFrame:
    """Every document under the fixed rules and under the limits of its language and source."""
    scored = quality_rules.score(t.documents.select("doc_id", "lang", "source", "text"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return scored.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in columns])


@catalog.add()
def op13_embedding_whitening(t) -> DataFrame:
    """Whitened coordinates of every embedding along the first 32 components."""
    return whitening.whiten(t.embeddings, whitening.fit(t.embeddings))
