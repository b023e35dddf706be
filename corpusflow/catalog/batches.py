"""Order, batching, ranking, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.catalog.aggregations import SQL_BATCHES, document_batches
from corpusflow.functions import numeric, text as X
from corpusflow.operators import aggregates, batching, hypotheses, mixing
from corpusflow.operators.unions import stack_rows

catalog = Catalog()


@catalog.add("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents")
def length_order(t: Tables):
    return batching.length_order(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id")


@catalog.add(
    """SELECT conv_id, turn, row_number() OVER (ORDER BY md5(concat_ws('|', conv_id, turn, 7, 3)), conv_id, turn) - 1 AS pos FROM conversations"""
)
def epoch_shuffle(t: Tables):
    return batching.epoch_shuffle(t.conversations.select("conv_id", "turn"), ["conv_id", "turn"], seed=7, epoch=3)


@catalog.add(f"WITH {SQL_BATCHES} SELECT doc_id, bucket, salt, batch FROM batches")
def token_budget_batches(t: Tables):
    return document_batches(t).select("doc_id", "bucket", "salt", "batch")


@catalog.add(
    f"""WITH {C.SQL_BENCH_WORDS}, items AS (SELECT item_id, count(*)::BIGINT AS n, list(duration ORDER BY t) AS ids FROM words GROUP BY item_id),
    sized AS (SELECT *, greatest(ceil(n / 8.0), 1)::BIGINT * 8 AS bucket, {C.sql_hash('item_id')} AS h FROM items),
    crowds AS (SELECT bucket, count(*) AS c FROM sized WHERE bucket <= 200 GROUP BY bucket),
    salted AS (SELECT s.*, CASE WHEN c IS NULL THEN h ELSE 0 END AS salt FROM sized s LEFT JOIN crowds USING (bucket)),
    b AS (SELECT *, (row_number() OVER (PARTITION BY bucket, salt ORDER BY n DESC, item_id) - 1) // greatest(200 // bucket, 1) AS batch FROM salted),
    m AS (SELECT *, max(n) OVER (PARTITION BY bucket, salt, batch) AS width FROM b),
    p AS (SELECT *, list_concat(ids::BIGINT[], list_transform(range(0, width - n), lambda x: 1)) AS padded FROM m)
    SELECT bucket, salt, batch, string_agg(item_id::VARCHAR, ' ' ORDER BY n DESC, item_id) AS keys, string_agg(n::VARCHAR, ' ' ORDER BY n DESC, item_id) AS lengths,
      string_agg(array_to_string(padded, ','), ' ' ORDER BY n DESC, item_id) AS tokens, sum(n)::BIGINT AS ntokens, count(*)::BIGINT AS nsentences,
      sum(n)::BIGINT AS n_unmasked FROM p GROUP BY bucket, salt, batch"""
)
def pad_collate(t: Tables):
    ids = F.transform(X.words(F.col("text")), lambda w: F.length(w))
    items = t.benchmark.select("item_id", ids.alias("ids")).withColumn("n", F.size("ids").cast("bigint"))
    planned = batching.token_batches(items, "n", "item_id", max_tokens=200, width=8)
    packed = batching.pad_collate(planned, "item_id", "ids", pad=1)
    rows = F.transform("tokens", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ","))
    shown = F.aggregate(
        F.flatten("mask"), F.lit(0).cast("bigint"), lambda acc, m: acc + F.when(m, 1).otherwise(0)
    )
    return packed.select(
        "bucket", "salt", "batch", C.joined(F.col("keys")).alias("keys"), C.joined(F.col("lengths")).alias("lengths"),
        F.array_join(rows, " ").alias("tokens"), F.col("ntokens").cast("bigint").alias("ntokens"),
        F.col("nsentences").cast("bigint").alias("nsentences"), shown.alias("n_unmasked"),
    )


@catalog.add("SELECT o_orderkey, o_orderkey % 4 AS shard FROM orders")
def shard(t: Tables):
    parts = [
        batching.shard(t.orders.select("o_orderkey"), 4, k, F.col("o_orderkey")).withColumn("shard", F.lit(k).cast("bigint"))
        for k in range(4)
    ]
    return stack_rows(*parts)


def scored_documents(t: Tables):
    words = X.words(F.col("text"))
    sized = t.documents.select("lang", "source", "doc_id", "n_chars", words.alias("tokens"), F.size(words).alias("n_words"))
    score = numeric.hypothesis_score(
        -F.col("n_chars") / 10.0, F.col("n_words") + 1, 0.9, F.pmod("doc_id", F.lit(3)), 0.5,
        F.when(F.pmod("doc_id", F.lit(11)) == 5, F.lit(float("nan"))).otherwise(F.col("doc_id") * -0.001), 0.7,
    )
    return sized, score


SQL_SCORED = f"""
sized AS (SELECT lang, source, doc_id, n_chars, {C.sql_words('text')} AS w, len({C.sql_words('text')}) AS n_words FROM documents),
scored AS (SELECT *, CASE WHEN doc_id % 11 = 5 THEN '-inf'::DOUBLE ELSE (-n_chars / 10.0::DOUBLE + doc_id * -0.001::DOUBLE * 0.7::DOUBLE - doc_id % 3 * 0.5::DOUBLE)
  / pow(n_words + 1, 0.9::DOUBLE) END AS score FROM sized)"""


@catalog.add(
    f"""WITH {SQL_SCORED}, r AS (SELECT lang, source, doc_id, score, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id)::BIGINT AS rank
      FROM scored WHERE n_words BETWEEN 1 AND 2000)
    SELECT lang, source, doc_id, rank, CASE WHEN isinf(score) THEN -1e9 ELSE round(score, 6) END AS score FROM r WHERE rank <= 3"""
)
def nbest_rank(t: Tables):
    sized, score = scored_documents(t)
    ranked = hypotheses.nbest_rank(sized, ["lang", "source"], "doc_id", score, 3, F.col("n_words"), max_len=2000)
    shown = F.when(F.col("score") == float("-inf"), F.lit(-1e9)).otherwise(F.round("score", 6))
    return ranked.select("lang", "source", "doc_id", F.col("rank").cast("bigint").alias("rank"), shown.alias("score"))


@catalog.add(
    f"""WITH w AS (SELECT conv_id, turn, {C.sql_words('text')} AS w FROM conversations),
    g AS (SELECT conv_id, turn, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(generate_series(1, len(w) - 2)) u(i)),
    bad AS (SELECT DISTINCT conv_id, turn FROM g GROUP BY conv_id, turn, g HAVING count(*) > 1)
    SELECT conv_id, turn, len(w)::BIGINT AS n_words FROM w WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.conv_id = w.conv_id AND bad.turn = w.turn)"""
)
def no_repeat_ngram_filter(t: Tables):
    hyps = t.conversations.select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    return hypotheses.no_repeat_ngram(hyps, F.col("w"), 3).select("conv_id", "turn", F.size("w").cast("bigint").alias("n_words"))


@catalog.add(
    f"""WITH {SQL_SCORED} SELECT lang, source, doc_id, regexp_replace(array_to_string(list_transform(w, lambda x: ' ' || x), ''), '^ ', '') AS text
    FROM scored QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) = 1"""
)
def one_best_text(t: Tables):
    sized, score = scored_documents(t)
    pieces = sized.withColumn("tokens", F.concat(F.transform("tokens", lambda w: F.concat(F.lit(X.PIECE_MARKER), F.replace(w, F.lit("_"), F.lit(" ")))), F.array(F.lit(X.EOS))))
    return hypotheses.one_best(pieces, ["lang", "source"], "doc_id", "tokens", score)


@catalog.add(
    """SELECT doc_id AS id, text, lang, 'documents' AS split FROM documents
    UNION ALL SELECT item_id, text, NULL, 'benchmark' FROM benchmark
    UNION ALL SELECT conv_id * 1000 + turn, text, NULL, 'conversations' FROM conversations"""
)
def concat_splits(t: Tables):
    return mixing.concat_splits(_texts(t), "documents,benchmark,conversations")


def _texts(t: Tables):
    return {
        "documents": t.documents.select(F.col("doc_id").alias("id"), "text", "lang"),
        "benchmark": t.benchmark.select(F.col("item_id").alias("id"), "text"),
        "conversations": t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"),
    }


def _copies(table: str, key: str, ratio: float, limit: int) -> str:
    whole = int(ratio)
    cut = round((ratio - whole) * 2**32)
    return f"""SELECT id, c AS copy, '{table}' AS modality FROM (SELECT {key} AS id, length(text) AS n,
        {whole} + CASE WHEN {C.sql_hash(key, "'1'", "'2'")} < {cut} THEN 1 ELSE 0 END AS copies FROM {table}) s,
      unnest(generate_series(0, copies - 1)) u(c) WHERE n <= {limit}
    UNION ALL SELECT {key}, -1, '{table}' FROM {table} WHERE length(text) > {limit}"""


@catalog.add(
    " UNION ALL ".join(
        [
            _copies("documents", "doc_id", 1.0, 6000),
            _copies("conversations", "conv_id * 1000 + turn", 0.5, 6000),
            _copies("benchmark", "item_id", 2.25, 1024),
        ]
    )
)
def mix_modalities(t: Tables):
    tables = {name: df.withColumn("n", F.length("text")) for name, df in _texts(t).items()}
    limits = {"documents": (6000, 6000), "conversations": (6000, 6000), "benchmark": (1024, 6000)}
    ratios = {"documents": 1.0, "conversations": 0.5, "benchmark": 2.25}
    mixed, rejected = mixing.mix_modalities(tables, ratios, lengths=("n", "n"), limits=limits, seed=1, epoch=2)
    both = stack_rows(mixed, rejected.withColumn("copy", F.lit(-1)))
    return both.select("id", F.col("copy").cast("bigint").alias("copy"), "modality")


@catalog.add(
    f"""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), sh AS (SELECT lang, n, n / sum(n) OVER () AS share FROM s),
    r AS (SELECT lang, n, sqrt(share) / sum(sqrt(share)) OVER () / share AS ratio FROM sh),
    k AS (SELECT lang, n, ratio, ceil(round(n * ratio, 9))::BIGINT AS size FROM r),
    p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {C.sql_hash('doc_id', '1', '2')}, doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, lang, pos AS draw FROM p JOIN k USING (lang) WHERE ratio < 1 AND pos < size
    UNION ALL
    SELECT p.doc_id, d.lang, d.draw FROM (SELECT lang, draw, ({C.sql_hash('lang', 'draw', '1', '2')}::DOUBLE * n / 4294967296)::DOUBLE AS target
      FROM k, unnest(generate_series(0, size - 1)) u(draw) WHERE ratio >= 1) d JOIN p ON p.lang = d.lang AND p.pos = floor(d.target)::BIGINT"""
)
def resample_by_ratio(t: Tables):
    documents = t.documents.select("doc_id", "lang")
    ratios = aggregates.size_ratios(mixing.dataset_sizes(documents, "lang"), 0.5)
    return mixing.resample(documents, "lang", ["doc_id"], ratios, seed=1, epoch=2)
