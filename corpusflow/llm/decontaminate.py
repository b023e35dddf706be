"""Benchmark decontamination by winnowing.

A text is lower-cased in A-Z and read as words. A *window* of the benchmark is ``SPAN`` consecutive words of
an item; an item of fewer words is one window of its own length. For spans of length L, the hashes of
k-word grams (k = min(``GRAM``, L)) are winnowed: the least hash of each L - k + 1 consecutive grams is kept,
on both sides. A span of L words holds exactly that many grams, so each shared span shares a kept gram. Kept
grams are joined; around each place of a joined gram, all spans that contain it are compared word by word
(64-bit word hashes) between document and item. The words of the spans that agree are hit.

Only DataFrame functions run. The kept grams of the benchmark are broadcast when they were counted to be at
most ``BROADCAST_GRAMS``; a larger benchmark is joined by a shuffle of grams and document keys, and documents
are fetched for the matches alone.

A null text has no words: nothing is hit. A null ``item_id`` marks words but is not counted or listed.
Rows with equal ids and texts get equal results; equal ids with different texts are told apart by a hash of
the text. Null ids are ids like others. Further columns pass through ``clean`` and are not read by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.native_words import gram_hashes, let, word_hashes, words
from corpusflow.llm.tables import drop_rows, row_id, text_of
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written

SPAN = 10
GRAM = 5
#: About 30 MB.
BROADCAST_GRAMS = 200_000


def _text_key() -> Column:
    return F.xxhash64(text_of("text"))


def _kept(grams: Column, span: int, k: int) -> Column:
    """The distinct least gram hashes over windows of ``span - k + 1`` grams."""
    width = span - k + 1
    if width == 1:
        return F.array_distinct(grams)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (width - 1)), lambda j: F.array_min(F.slice(grams, j, width))))


def _winnowed(df: DataFrame, span: int) -> DataFrame:
    """``df`` with ``n``, ``hashes``, ``grams`` and ``kept`` in place of its text; null for texts below ``span`` words."""
    k = min(GRAM, span)

    def of(hashes: Column) -> Column:
        whole = let(
            gram_hashes(hashes, F.size(hashes), k),
            lambda grams: F.struct(F.size(hashes).alias("n"), hashes.alias("hashes"), grams.alias("grams"), _kept(grams, span, k).alias("kept")),
        )
        return F.when(F.size(hashes) >= span, whole)

    return df.withColumn("w", let(word_hashes("text"), of)).drop("text").select("*", "w.*").drop("w")


def _by_gram(winnowed: DataFrame, *columns: str) -> DataFrame:
    """One row for each kept gram. The outer form: a plain explode adds a filter that evaluates the array a second time."""
    return winnowed.select(*columns, F.explode_outer("kept").alias("gram"))


def _places(grams: Column, gram: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda p: grams[p] == gram)


def _item_grams(benchmark: DataFrame, span: int) -> DataFrame:
    """(gram, item_id, at, n_item, around): each place of a kept gram, with the words that spans over it can hold."""
    k = min(GRAM, span)
    size = F.size(words("text"))
    own = benchmark.filter(size >= SPAN if span == SPAN else size == span).select("item_id", "text")
    placed = written(_by_gram(_winnowed(own, span), "item_id", "n", "hashes", "grams"), "benchmark-kept")
    placed = placed.select("gram", "item_id", "n", "hashes", F.explode(_places(F.col("grams"), F.col("gram"))).alias("at"))
    reach = F.sequence(F.col("at") - (span - k), F.col("at") + span - 1)
    around = F.transform(reach, lambda x: F.when((x >= 0) & (x < F.col("n")), F.col("hashes")[x]))
    return placed.select("gram", "item_id", "at", F.col("n").alias("n_item"), around.alias("around"))


def _agreeing(span: int) -> Column:
    """Starts of the spans over a place of the gram in a document that agree with the item."""
    k = min(GRAM, span)
    around, at, n_item, gram = (F.col(c) for c in ("around", "at", "n_item", "gram"))
    hashes, grams, n = F.col("hashes"), F.col("grams"), F.col("n")

    def over(p: Column) -> Column:
        first, last = F.greatest(p - (span - k), p - at, F.lit(0)), F.least(p, p - at + n_item - span, n - span)
        agree = F.filter(F.sequence(first, last), lambda s: F.slice(hashes, s + 1, span) == F.slice(around, s - p + (span - k) + 1, span))
        return F.when(first <= last, agree).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(_places(grams, gram), over))


def _hits(docs: DataFrame, benchmark: DataFrame, span: int, broadcast_grams: int) -> DataFrame:
    """(doc_id, text_key, item_id, start, span) for each agreeing span."""
    asked = written(_item_grams(benchmark, span), "benchmark-grams")
    texts = _winnowed(docs.select("doc_id", _text_key().alias("text_key"), text_of("text").alias("text")), span)
    if asked.count() <= broadcast_grams:
        rows = _by_gram(texts, "doc_id", "text_key", "n", "hashes", "grams").join(F.broadcast(asked), "gram")
    else:
        found = _by_gram(texts, "doc_id", "text_key").distinct().join(asked, "gram")
        found = written(found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"}), "benchmark-matches")
        same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
        rows = texts.join(found, same)
    starts = rows.select("doc_id", "text_key", "item_id", F.explode_outer(_agreeing(span)).alias("start"), F.lit(span).alias("span"))
    return starts.filter("start IS NOT NULL")


def _covered(spans: Column) -> Column:
    """How many words the spans (start, span) cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["span"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("total"),
        )

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["total"])


def scan(docs: DataFrame, benchmark: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) for each row of ``docs``; ``items`` are sorted strings."""
    lengths = benchmark.select(F.size(words("text")).alias("n")).filter(F.col("n").between(1, SPAN - 1)).distinct().collect()
    spans = [SPAN, *sorted(row["n"] for row in lengths)]
    found = stack_rows(*[_hits(docs, benchmark, n, broadcast_grams) for n in spans])
    spans = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.collect_set(F.struct("start", "span")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    hits = written(spans.select("hit_id", "hit_key", _covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items")), "hits")
    rows = docs.select("doc_id", _text_key().alias("text_key"), F.size(words("text")).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return rows.join(hits, same, "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""
    hit = scan(docs, benchmark).filter("n_hit > 0").select(row_id().alias("k0"), F.col("text_key").alias("k1"))
    return drop_rows(docs, [row_id(), _text_key()], hit)
