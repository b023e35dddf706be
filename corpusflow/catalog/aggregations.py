"""Corpus statistics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.functions import text as X
from corpusflow.functions.arrays import target_length as total_frames
from corpusflow.operators import aggregates, bleu, mixing, similarity
from corpusflow.operators.batching import BATCH_KEY, token_batches

catalog = Catalog()
BUDGET = {"max_tokens": 40_000, "rows_per_salt": 50}

SQL_BATCHES = f"""
sized AS (SELECT doc_id, lang, n_chars, greatest(ceil(n_chars / 256.0), 1)::BIGINT * 256 AS bucket, {C.sql_hash('doc_id')} AS h FROM documents),
crowds AS (SELECT bucket, count(*) AS n FROM sized WHERE bucket <= 40000 GROUP BY bucket),
salted AS (SELECT s.*, CASE WHEN n IS NULL THEN h ELSE h % ceil(n / 50.0)::BIGINT END AS salt FROM sized s LEFT JOIN crowds USING (bucket)),
batches AS (SELECT *, (row_number() OVER (PARTITION BY bucket, salt ORDER BY n_chars DESC, doc_id) - 1)
    // greatest(40000 // bucket, 1) AS batch FROM salted)"""


def document_batches(t: Tables):
    return token_batches(t.documents.select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", **BUDGET)


@catalog.add(f"""SELECT token, count(*)::BIGINT AS "count" FROM (SELECT unnest({C.sql_words('text')}) AS token FROM documents) GROUP BY token""")
def token_vocab(t: Tables):
    return aggregates.token_vocab(t.documents, X.words(F.col("text")))


@catalog.add(
    """SELECT i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(greatest(stddev_pop(embedding[i]::DOUBLE), 1e-5), 6) AS std
    FROM embeddings, unnest(generate_series(1, 64)) u(i) GROUP BY i"""
)
def global_cmvn(t: Tables):
    stats = aggregates.cmvn_stats(t.embeddings, F.col("embedding"))
    return stats.select(F.col("dim").cast("bigint").alias("dim"), C.r6(F.col("mean"), "mean"), C.r6(F.col("std"), "std"))


@catalog.add(
    """SELECT min(value) AS pitch_min, max(value) AS pitch_max, round(min(ln(value + 1)), 6) AS energy_min, round(max(ln(value + 1)), 6) AS energy_max FROM events"""
)
def feature_min_max(t: Tables):
    row = aggregates.feature_range(t.events, pitch=F.col("value"), energy=F.log1p("value"))
    return row.select("pitch_min", "pitch_max", C.r6(F.col("energy_min"), "energy_min"), C.r6(F.col("energy_max"), "energy_max"))


def dropped_words(t: Tables):
    """Predictions: the lowercased text without every seventh word; references: the text."""
    kept = F.filter(X.words(F.col("text")), lambda _, i: (i + 1) % 7 != 0)
    return t.documents.select(
        F.col("doc_id").alias("idx"),
        "lang",
        X.normalize_line(F.array_join(kept, " "), "prediction").alias("prediction"),
        X.normalize_line(F.col("text")).alias("reference"),
    )


def sql_13a(col: str) -> str:
    text = f"regexp_replace({col}, '[{C.SPACE_CLASS}]+$', '')"
    text = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in X.ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"' ' || {text} || ' '"
    for pattern, replacement in C.SQL_13A_RULES:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return C.sql_words(text)


def sql_bleu(pairs: str, by: str) -> str:
    """Scores of ``pairs`` (k, by, h, r: token lists) per ``by``."""
    orders = []
    for n in range(1, 5):
        for side in "hr":
            gram = " || ' ' || ".join(f"{side}[i{f' + {o}' if o else ''}]" for o in range(n))
            orders.append(
                f"SELECT k, g, {n} AS n, {gram} AS gram, {int(side == 'h')} AS ch, {int(side == 'r')} AS cr "
                f"FROM pairs, unnest(generate_series(1, len({side}) - {n - 1})) u(i)"
            )
    return f"""WITH pairs AS ({pairs}),
    grams AS ({' UNION ALL '.join(orders)}),
    counted AS (SELECT k, g, n, gram, sum(ch) AS ch, sum(cr) AS cr FROM grams GROUP BY ALL),
    o AS (SELECT g, n, sum(least(ch, cr))::DOUBLE AS m, sum(ch)::DOUBLE AS t, sum(cr)::DOUBLE AS rt FROM counted GROUP BY g, n),
    p AS (SELECT *, CASE WHEN t = 0 THEN NULL WHEN m = 0 THEN 100 / (2 ** sum(CASE WHEN t > 0 AND m = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY g ORDER BY n) * t) ELSE 100 * m / t END AS prec FROM o),
    s AS (SELECT g, max(CASE WHEN n = 1 THEN t END) AS hl, max(CASE WHEN n = 1 THEN rt END) AS rl, sum(m) AS matches,
        count(prec) AS np, sum(ln(prec)) / 4 AS lp FROM p GROUP BY g),
    bp AS (SELECT *, CASE WHEN hl = 0 THEN 0 WHEN hl >= rl THEN 1 ELSE exp(1 - rl / hl) END AS b FROM s)
    SELECT {by} round(CASE WHEN matches > 0 AND np = 4 THEN b * exp(lp) ELSE 0 END, 6) AS bleu, round(b, 6) AS brevity_penalty,
      hl::BIGINT AS hyp_len, rl::BIGINT AS ref_len FROM bp"""


SQL_DROPPED = f"""SELECT doc_id AS k, {{by}} AS g,
      {sql_13a("lower(array_to_string(list_filter(" + C.sql_words('text') + ", lambda w, i: i % 7 <> 0), ' '))")} AS h,
      {sql_13a(C.sql_strip('text'))} AS r FROM documents"""


def _score_columns(df, *by):
    return df.select(*by, C.r6(F.col("bleu"), "bleu"), C.r6(F.col("brevity_penalty"), "brevity_penalty"), "hyp_len", "ref_len")


@catalog.add(sql_bleu(SQL_DROPPED.replace("{by}", "0"), ""))
def corpus_bleu(t: Tables):
    return _score_columns(bleu.corpus_bleu(dropped_words(t)))


@catalog.add(sql_bleu(SQL_DROPPED.replace("{by}", "lang"), "g AS lang,"))
def bleu_by_group(t: Tables):
    return _score_columns(bleu.corpus_bleu(dropped_words(t), by=["lang"]), "lang")


@catalog.add(f"WITH {C.SQL_BENCH_WORDS} SELECT item_id, sum(duration)::BIGINT AS n_frames FROM words GROUP BY item_id")
def target_length(t: Tables):
    durations = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    return t.benchmark.select("item_id", total_frames(durations).alias("n_frames"))


@catalog.add(
    f"""WITH {SQL_BATCHES} SELECT bucket, salt, batch, sum(n_chars)::BIGINT AS ntokens, count(*)::BIGINT AS nsentences, max(n_chars) AS max_len
    FROM batches GROUP BY bucket, salt, batch"""
)
def batch_counts(t: Tables):
    return aggregates.batch_counts(document_batches(t), BATCH_KEY, "n_chars")


@catalog.add(
    f"""WITH {SQL_BATCHES} SELECT bucket, salt, batch, count(*)::BIGINT AS nsentences,
      round(1 - sum(n_chars) / (max(n_chars) * count(*))::DOUBLE, 6) AS waste FROM batches GROUP BY bucket, salt, batch"""
)
def padding_waste(t: Tables):
    waste = aggregates.padding_waste(document_batches(t), BATCH_KEY, "n_chars")
    return waste.withColumn("waste", F.round("waste", 6))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@catalog.add(
    """SELECT k AS key, round(sum(CASE WHEN event_type = k THEN value ELSE 0 END) / count(*), 3) AS value, count(*)::DOUBLE AS sample_size
    FROM events, unnest(['click', 'error', 'purchase', 'signup', 'view']) u(k) GROUP BY k"""
)
def reduce_metrics(t: Tables):
    losses = [F.when(F.col("event_type") == e, F.col("value")).otherwise(0.0).alias(f"{e}_loss") for e in EVENT_TYPES]
    logs = t.events.select(*losses, F.lit(1).alias("sample_size"))
    return aggregates.reduce_metrics(logs, [f"{e}_loss" for e in EVENT_TYPES])


@catalog.add(
    f"""WITH {C.SQL_PAIRS.replace('pairs AS', 'p AS')},
    l AS (SELECT a.pos // 16 AS batch, a.pos % 16 AS i, b.pos % 16 AS j,
        -list_sum(list_transform(list_zip(a.x, b.y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 0.1 AS l
      FROM p a JOIN p b ON a.pos // 16 = b.pos // 16),
    s AS (SELECT batch, i, j, l, max(l) OVER r AS mr, max(l) OVER c AS mc FROM l
      WINDOW r AS (PARTITION BY batch, i), c AS (PARTITION BY batch, j)),
    e AS (SELECT batch, i, j, l, mr + ln(sum(exp(l - mr)) OVER (PARTITION BY batch, i)) AS lr,
        mc + ln(sum(exp(l - mc)) OVER (PARTITION BY batch, j)) AS lc FROM s)
    SELECT batch, count(*)::BIGINT AS n_rows, round(-0.5 * avg(l - lr + l - lc), 6) AS score FROM e WHERE i = j GROUP BY batch"""
)
def symmetric_contrastive_score(t: Tables):
    even, odd = C.even_odd(t)
    pairs = similarity.pair_similarity(even, odd, "l1", batch_rows=16)
    return similarity.contrastive_score(pairs, temperature=0.1, whole=False).withColumn("score", F.round("score", 6))


@catalog.add(
    f"""WITH {C.SQL_PAIRS} SELECT count(*)::BIGINT AS n_valid,
      round(avg(list_sum(list_transform(list_zip(x, y), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS mse FROM pairs WHERE label <> 0"""
)
def masked_vector_mse(t: Tables):
    even, odd = C.even_odd(t)
    pairs = even.withColumnRenamed("vec", "x1").join(odd.select("pos", F.col("vec").alias("x2")), "pos")
    return similarity.masked_mse(pairs, "x1", "x2", F.col("label") != 0).withColumn("mse", F.round("mse", 6))


@catalog.add(
    """WITH e AS (SELECT l_returnflag, avg(abs(l_extendedprice - l_quantity * 2000)) AS l1,
        avg((ln(l_quantity) - ln(l_linenumber + 1)) ** 2) AS dur, avg((l_discount - l_tax) ** 2) AS pitch,
        avg((l_quantity - l_linenumber) ** 2) AS energy FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round(l1, 4) AS l1, round(dur, 6) AS dur, round(pitch, 6) AS pitch, round(energy, 6) AS energy,
      round(l1 + dur + pitch + energy, 4) AS total FROM e"""
)
def regression_error_report(t: Tables):
    pairs = t.lineitem.select(
        "l_returnflag",
        F.col("l_extendedprice").alias("frame"),
        (F.col("l_quantity") * 2000).alias("frame_gold"),
        F.ln("l_quantity").alias("log_duration"),
        F.col("l_linenumber").alias("duration_gold"),
        F.col("l_discount").alias("pitch"),
        F.col("l_tax").alias("pitch_gold"),
        F.col("l_quantity").alias("energy"),
        F.col("l_linenumber").alias("energy_gold"),
    )
    errors = aggregates.regression_errors(pairs, ["l_returnflag"])
    places = {"l1": 4, "dur": 6, "pitch": 6, "energy": 6, "total": 4}
    return errors.withColumns({c: F.round(c, n) for c, n in places.items()})


@catalog.add(
    """WITH m AS (SELECT *, -value * 3 AS lp, max(-value * 3) OVER (PARTITION BY user_id, event_type) AS top FROM events)
    SELECT user_id, event_type, count(*)::BIGINT AS n_models, round(max(top) + ln(sum(exp(lp - top))) - ln(count(*)), 6) AS log_prob
    FROM m GROUP BY user_id, event_type"""
)
def ensemble_log_average(t: Tables):
    averaged = aggregates.ensemble_logavg(t.events, ["user_id", "event_type"], -F.col("value") * 3)
    return averaged.withColumn("log_prob", F.round("log_prob", 6))


@catalog.add(
    """WITH b AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1], vec_id) <= 5)
    SELECT label::BIGINT AS label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS value
    FROM b, unnest(generate_series(1, 64)) u(i) GROUP BY label, i"""
)
def best_k_vector_average(t: Tables):
    averaged = aggregates.average_best(t.embeddings, "label", [F.get("embedding", F.lit(0)), F.col("vec_id")], "embedding", 5)
    return averaged.select(
        F.col("label").cast("bigint").alias("label"), F.col("dim").cast("bigint").alias("dim"), C.r6(F.col("value"), "value")
    )


@catalog.add(
    f"""WITH w AS (SELECT lang, n_chars, {C.sql_words('text')} AS w FROM documents),
    v AS (SELECT lang, count(*)::BIGINT AS n_tokens, count(DISTINCT x)::BIGINT AS vocab_size FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang)
    SELECT lang, count(*)::BIGINT AS n_samples, sum(n_chars)::BIGINT AS n_frames, min(n_chars) AS min_len, round(avg(n_chars), 6) AS mean_len,
      max(n_chars) AS max_len, any_value(n_tokens) AS n_tokens, any_value(vocab_size) AS vocab_size FROM w JOIN v USING (lang) GROUP BY lang"""
)
def split_summary(t: Tables):
    summary = aggregates.split_summary(t.documents, "lang", F.col("n_chars"), X.words(F.col("text")))
    return summary.withColumn("mean_len", F.round("mean_len", 6))


@catalog.add(
    """WITH s AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang),
    p AS (SELECT lang, n, n / sum(n) OVER () AS share FROM s)
    SELECT lang, n, round(sqrt(share) / sum(sqrt(share)) OVER () / share, 6) AS size_ratio FROM p"""
)
def temperature_size_ratio(t: Tables):
    ratios = aggregates.size_ratios(mixing.dataset_sizes(t.documents, "lang"), 0.5)
    return ratios.withColumn("size_ratio", F.round("size_ratio", 6))
