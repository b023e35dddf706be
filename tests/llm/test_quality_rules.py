"""Quality rules: measures against brute force, sketches and limits, the rows that all operators must bear."""

import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import LONG, ROWS, documents, prose  # noqa: E402

from corpusflow.llm import quality_rules as Q  # noqa: E402


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines)
    )


def odd_texts():
    draw = random.Random(8)
    parts = ["a", "b", "ab", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "#", "$%", "|", "日"]
    yield from (None, "", " \n \n", "a " * 8, "a " * 9, "x\n" * 40, "one two three four five six seven eight " * 2)
    for _ in range(400):
        yield "".join(draw.choice(parts[: draw.randint(2, len(parts))]) for _ in range(draw.randint(0, 120)))


def test_measures():
    for text in odd_texts():
        assert Q.measure(text) == brute(text), ascii(text)


def test_measures_of_a_very_long_text():
    long = LONG * 40
    n, *_, repeated, _ = Q.measure(long)
    assert n == 40 * 30_000 - 39 and 0.99 * n < repeated <= n


def test_buckets_lie_below_by_a_64th_at_most(spark):
    values = [*range(300), 2**20 - 1, 2**20, 10**12 + 7, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.bucket(F.col("v")).alias("low")).collect()
    assert all(r.low <= r.v and (r.v - r.low) * 64 <= r.v and (r.v >= 128 or r.low == r.v) for r in rows)
    assert all(a.low <= b.low for a, b in zip(rows, rows[1:]))


def sketched(spark):
    docs = spark.createDataFrame([(i, prose(40 + i % 9), "ab"[i % 2], "s" * (i % 3)) for i in range(120)], "doc_id long, text string, lang string, source string")
    return Q.measured(docs)


def test_shards_merge_to_the_sketch_of_all(spark):
    rows = sketched(spark)
    whole = sorted(map(tuple, Q.sketches(rows).collect()))
    shards = [Q.sketches(rows.filter(F.pmod("doc_id", F.lit(4)) == k)) for k in range(4)]
    union = shards[0].unionAll(shards[1]).unionAll(shards[2].unionAll(shards[3]))
    assert sorted(tuple(r) for r in Q.merged(union, "lang", "source").select("lang", "source", "measure", "low", "n").collect()) == whole


def test_quartiles_are_within_the_error_of_the_exact_ones(spark):
    rows = sketched(spark)
    exact = rows.select("lang", (100 * F.col("measures.word_chars") / F.col("measures.n_words")).cast("long").alias("v")).toPandas()
    for r in Q.quartiles(Q.merged(Q.sketches(rows), "lang"), "lang").filter("measure = 'word_length'").collect():
        v = np.sort(exact[exact.lang == r.lang].v.to_numpy())
        assert r.rows == len(v)
        for part, got in ((1, r.q1), (3, r.q3)):
            true = v[-(-part * len(v) // 4) - 1]
            assert got <= true and (true - got) * 64 <= true


def test_small_groups_take_the_limits_of_their_language_then_of_all(spark):
    row = lambda lang, source, low, n: (lang, source, "word_length", low, n)
    sketch = spark.createDataFrame(
        [row("a", "big", 500, 40), row("a", "big", 600, 40), row("a", "few", 900, 2), row(None, None, 100, 1), row("b", None, 300, 60)],
        "lang string, source string, measure string, low long, n long",
    )
    most = {(r.lang, r.source): (r.word_length.least, r.word_length.most) for r in Q.limits(sketch, least_rows=50).collect()}
    fence = lambda q1, q3: (q1 - 3 * (q3 - q1 + 100), q3 + 3 * (q3 - q1 + 100))
    assert most == {("a", "big"): fence(500, 600), ("a", "few"): fence(500, 600), ("b", None): fence(300, 300), (None, None): fence(300, 600)}


def test_rules_of_edge_rows(spark):
    docs = documents(spark).withColumns({"lang": F.col("k0"), "source": F.col("digest"), "measures": F.lit(7), "row": F.lit(1)})
    scored = Q.score(docs).collect()
    assert len(scored) == len(ROWS)
    want = sorted((repr(i), *brute(t)) for i, t, *_ in ROWS)
    assert sorted((repr(r.doc_id), *[r.measures[c] for c in Q.COUNTS]) for r in scored) == want
    for r in scored:
        assert r.measures.base_failed == (r.measures.n_words < 20 or 100 * r.measures.n_repeat_words > 30 * r.measures.n_words)
        assert not (r.measures.kept and r.measures.base_failed)
    kept = Q.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.measures.kept for r in scored) > 0
    assert Q.score(docs.limit(0)).count() == 0 and Q.accepted(docs.limit(0)).count() == 0


def test_outliers_of_a_source_go_and_the_others_stay(spark):
    good = [(i, prose(60), "en", "hot") for i in range(300)] + [(1000 + i, prose(60).replace(" ", " | "), "en", "tables") for i in range(300)]
    bad = [(2000 + i, prose(60).replace(" ", "%%% "), "en", "hot") for i in range(20)] + [(3000, prose(60).replace(" ", " | "), "en", "hot")]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.accepted(docs).collect()}
    assert kept == {i for i, *_ in good}


@pytest.mark.parametrize("window", [1, 3])
def test_other_windows(window):
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 4])
    assert Q.repeated_words(ids, 4) == 0 and Q.repeated_words(ids, 2) == 6
