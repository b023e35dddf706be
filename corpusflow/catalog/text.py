"""Text functions, named transforms, quarantined user functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F, types as T

from corpusflow.catalog import Catalog, Tables
from corpusflow.catalog import common as C
from corpusflow.catalog.aggregations import sql_13a
from corpusflow.functions import text as X
from corpusflow.operators.quarantine import safe_map
from corpusflow.operators.transforms import TransformRegistry
from corpusflow.operators.unions import stack_rows

catalog = Catalog()


@catalog.add(
    f"""SELECT item_id, regexp_replace(replace(array_to_string(list_transform({C.sql_words('text')}, lambda w: ' ' || w || CASE WHEN length(w) = 3 THEN ' ' ELSE '' END), ''), '_', ' '), '^ ', '') AS text FROM benchmark"""
)
def detokenize_hypothesis(t: Tables):
    # Every three-letter word is followed by an unknown piece; the sentence carries both end marks.
    def pieces(w):
        unknown = F.when(F.length(w) == 3, F.array(F.lit(X.UNK))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit(X.PIECE_MARKER), w)), unknown)

    tokens = F.concat(F.array(F.lit(X.BOS)), F.flatten(F.transform(X.words(F.col("text")), pieces)), F.array(F.lit(X.EOS)))
    return t.benchmark.select("item_id", X.detokenize(tokens).alias("text"))


@catalog.add(f"SELECT item_id, array_to_string({C.sql_words('text')}, ' ') AS phonemes FROM benchmark")
def phoneme_string(t: Tables):
    symbols = F.concat(X.words(F.col("text")), F.array(F.lit(X.EOS)))
    return t.benchmark.select("item_id", X.phoneme_string(symbols).alias("phonemes"))


SQL_CHARS = "list_transform(regexp_split_to_array(text, ''), lambda c: CASE WHEN c = ' ' THEN '|' ELSE c END)"


@catalog.add(
    f"""SELECT item_id, lower({C.sql_strip(f"replace(array_to_string({SQL_CHARS}, ''), '|', ' ')")}) AS collapsed,
      lower({C.sql_strip(f"replace(array_to_string({SQL_CHARS}, ' '), '|', ' ')")}) AS spaced FROM benchmark"""
)
def asr_postprocess(t: Tables):
    chars = F.transform(F.split("text", ""), lambda c: F.when(c == " ", "|").otherwise(c))
    return t.benchmark.select(
        "item_id",
        X.asr_postprocess(chars, "collapse").alias("collapsed"),
        X.asr_postprocess(chars, "none").alias("spaced"),
    )


SQL_PIECES = C.sql_words("replace(replace(url, '/', ' '), 'example', ' NULLINIT ')")


@catalog.add(
    rf"""SELECT page_id, rtrim(array_to_string(list_transform(list_filter({SQL_PIECES}, lambda p: p NOT IN ('NULLINIT', 'nullinit')),
      lambda p: CASE WHEN regexp_matches(p, '\p{{N}}$') THEN p || ' ' ELSE p END), ''), ' ') AS text FROM pages"""
)
def merge_syllables(t: Tables):
    pieces = F.replace(F.replace("url", F.lit("/"), F.lit(" ")), F.lit("example"), F.lit(" NULLINIT "))
    return t.pages.select("page_id", X.merge_syllables(pieces).alias("text"))


@catalog.add(f"SELECT item_id, array_to_string(list_transform({C.sql_words('text')}, lambda s: left(s, length(s) - 1)), ' ') AS text FROM benchmark")
def strip_tone(t: Tables):
    return t.benchmark.select("item_id", X.strip_tone(F.col("text")).alias("text"))


@catalog.add(f"SELECT doc_id, len({C.sql_words('text')})::BIGINT AS n, array_to_string({C.sql_words('text')}, ' ') AS text FROM documents")
def strip_language_tags(t: Tables):
    tagged = F.concat(F.array(F.concat(F.lit("<lang:"), F.col("lang"), F.lit(">"))), X.words(F.col("text")))
    kept = t.documents.select("doc_id", X.strip_lang_tags(tagged).alias("tokens"))
    return kept.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("text"))


@catalog.add(f"SELECT conv_id, turn, array_to_string({sql_13a('text')}, ' ') AS tokens FROM conversations")
def tokenize_13a(t: Tables):
    return t.conversations.select("conv_id", "turn", F.array_join(X.tokenize_13a(F.col("text")), " ").alias("tokens"))


@catalog.add(
    f"""SELECT doc_id, i - 1 AS line_no, lower({C.sql_strip('l[i]')}) AS prediction, {C.sql_strip('l[i]')} AS reference
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(generate_series(1, len(l))) u(i)"""
)
def normalize_line(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        X.normalize_line(F.col("line"), "prediction").alias("prediction"),
        X.normalize_line(F.col("line"), "reference").alias("reference"),
    )


transforms = TransformRegistry()


@transforms.register("lowercase")
def _lowercase(df):
    return df.withColumn("text", F.lower("text"))


@transforms.register("single_spaces")
def _single_spaces(df):
    return df.withColumn("text", F.array_join(X.words(F.col("text")), " "))


CONFIG = {
    "source_transforms": {"_train": ["lowercase"]},
    "source_feature_transforms": {"*": ["single_spaces"]},
}


@catalog.add(
    f"""SELECT doc_id, 'train' AS split, lower(array_to_string({C.sql_words('text')}, ' ')) AS text FROM documents
    UNION ALL SELECT doc_id, 'dev', array_to_string({C.sql_words('text')}, ' ') FROM documents"""
)
def split_transforms(t: Tables):
    documents = t.documents.select("doc_id", "text")
    train = transforms.apply(documents, CONFIG, "source", "train", train=True)
    dev = transforms.apply(documents, CONFIG, "source", "dev", train=False)
    return stack_rows(train.withColumn("split", F.lit("train")), dev.withColumn("split", F.lit("dev")))


def _title(html: str) -> str:
    """A title without accents, which needs Unicode decomposition: no built-in function has it."""
    title = re.search(r"<title>([^<]*)</title>", html).group(1)
    if "&" in title:
        raise ValueError("entity in title")
    return "".join(c for c in unicodedata.normalize("NFD", title) if not unicodedata.combining(c))


@catalog.add(
    r"""WITH p AS (SELECT page_id, regexp_matches(html, '<title>[^<]*</title>') AS found, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, CASE WHEN found AND title NOT LIKE '%&%' THEN strip_accents(title) END AS value,
      CASE WHEN NOT found THEN 'AttributeError' WHEN title LIKE '%&%' THEN 'ValueError' END AS error FROM p"""
)
def quarantined_map(t: Tables):
    mapped = safe_map(t.pages.select("page_id", "html"), _title, "html", T.StringType())
    return mapped.select("page_id", "value", F.split("error", ":")[0].alias("error"))
