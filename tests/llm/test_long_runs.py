"""Every operator over texts with a million blanks, line breaks, letters, symbols or digits in a row."""

import os
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import ROWS, RUNS, documents  # noqa: E402

from corpusflow.llm import (  # noqa: E402
    bpe,
    decontaminate,
    exact_dedup,
    license_scan,
    lm_score,
    nbsvm,
    ngram_join,
    quality_rules,
    sequence_packing,
    shard_packing,
    warc_store,
)
from corpusflow.session import scratch_path  # noqa: E402

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).dropna().distinct()


def warc(docs):
    folder = scratch_path(docs.sparkSession, "runs")
    warc_store.archive(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), folder)
    warc_store.export_warc(docs.sparkSession, folder, f"{folder}/files")
    return warc_store.described_files(docs.sparkSession, f"{folder}/files")


OPERATORS = {
    "ngram_join": lambda docs: ngram_join.join(docs),
    "license_scan": lambda docs: docs.select("doc_id").join(license_scan.identify(docs).select("doc_id").distinct(), "doc_id", "left"),
    "warc": warc,
    "shards": lambda docs: shard_packing.shard_by_bytes(docs, 3),
    "decontaminate": lambda docs: decontaminate.scan(docs, documents(docs.sparkSession, RUNS).select(F.col("doc_id").alias("item_id"), "text")),
    "lm_score": lambda docs: lm_score.score(docs.select("doc_id", "text"), *lm_score.fit(docs, labels(docs).filter("quality = 1").select("doc_id"))),
    "bpe": lambda docs: bpe.decode(bpe.encode(docs, WORDS), WORDS),
    "nbsvm": lambda docs: nbsvm.score(docs, nbsvm.fit(docs, labels(docs))),
    "exact_dedup": lambda docs: exact_dedup.group_rows(*exact_dedup.by_age(docs.select("doc_id", exact_dedup.text_digest("text").alias("digest")))),
    "packing": lambda docs: sequence_packing.unpack(sequence_packing.pack(docs, BYTES, public_tokenizers.PATTERN, 50_256), 2),
    "quality_rules": lambda docs: quality_rules.score(docs.withColumns({"lang": F.lit("en"), "source": F.col("k0")})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_bears_long_runs(spark, name):
    rows = [r for r in ROWS if r[0] is not None and r[0] < 9] + RUNS
    assert OPERATORS[name](documents(spark, rows)).count() == len(rows)
