import os
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import ROWS, documents  # noqa: E402
from test_dedup import brute_classes, normal  # noqa: E402
from test_scans import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusflow.llm import nbsvm  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def kept_by_brute_force(rows, items):
    """What the exact, near and benchmark stages leave of rows with ids."""
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(normal(r[1]), r)
    rows = list(first.values())
    names, _ = brute_classes(rows)
    rows = [r for r, name in zip(rows, names, strict=True) if r[0] == name]
    return [r for r, (_, _, n_hit, _) in zip(rows, brute(rows, items), strict=True) if not n_hit]


def test_pipeline_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    docs = read("documents")
    model = nbsvm.fit(docs, read("labels"))
    good = [tuple(r) for r in nbsvm.accepted(docs, model).select("doc_id", "text").collect()]
    want = kept_by_brute_force(good, [tuple(r) for r in read("benchmark").collect()])
    found = corpus_pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in want}
    assert 0 < len(found) < docs.count()
    assert {r.doc_id: bytes(r.ids) for r in found} == ids and len(found) == len(ids)
    assert {"lang", "source", "n_chars", "n_tokens", "decoded"} <= set(found[0].asDict())


def test_stages_bear_edge_rows_and_nothing(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema == docs.schema and out.count() <= len(rows)
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert encoded.count() == len(rows) and "ids" in encoded.columns
