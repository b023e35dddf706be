import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import ROWS, documents  # noqa: E402

from corpusflow.llm import bpe, lm_score, nbsvm  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"
ODD = [
    "don't they'll I'VE it's 'LL", "a<|endoftext|>b <|startoftext|><|endoftext|", "ΣΑΣ ΣΊΣΥΦΟΣ İstanbul ǅ ß ẞ",
    "é a\x1cb\x1d \x1e\x1f\x85\xa0x y　z​᠎ q﻿", "1234 ５６ ½ ² Ⅷ ٣٤", "😀👨‍👩‍👧 日本語 한국어 हिन्दी",
    "a" * 3000, "ab" * 1000 + "!" * 1000, "\x00\x01 \x7f\x80", "   ",
]


def odd_texts(n=800):
    draw = random.Random(3)
    parts = [*"abcdeXYZ '!?.0123\n\t\x0b\x1c\x1f\x85\xa0éÉΣσß", "<|endoftext|>", "<|startoftext|>", "é", "ͅ", "中", "🎉", "'s", "'LL", " "]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_are_those_of_the_library():
    ours, theirs = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    for text in odd_texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        found = ours.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids, ascii(text)
        assert ours.decode(found) == theirs.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_merge_alike():
    ours, draw = bpe.WordBpe(PATH), random.Random(1)
    for _ in range(500):
        raw = "".join(draw.choice("theanding") for _ in range(draw.randint(1, 60))).encode()
        parts = [ours.inner[b] for b in raw[:-1]] + [ours.last[raw[-1]]]
        assert ours.merge(list(parts)) == ours.merge_long(list(parts))


def test_bpe_of_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    theirs = Tokenizer.from_file(PATH)
    docs = documents(spark).withColumnRenamed("score", "ids")
    found = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert found.columns == ["doc_id", "digest", "k0", "ids", "n_tokens", "decoded"]
    want = []
    for doc_id, text, *_ in ROWS:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((repr(doc_id), len(ids), np.array(ids, "<u4").tobytes(), theirs.decode(ids, skip_special_tokens=False)))
    assert sorted((repr(r.doc_id), r.n_tokens, bytes(r["ids"]), r.decoded) for r in found.collect()) == sorted(want)
    assert bpe.encode(documents(spark, []), PATH).count() == 0


def test_classifier_is_right_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = nbsvm.fit(docs, labels)
    rows = nbsvm.score(docs.select("doc_id", "text"), model).join(labels.filter(nbsvm.held_out()), "doc_id").select("score", "quality").toPandas()
    assert len(rows) > 50 and ((rows["score"] >= 0.7) == (rows["quality"] == 1)).mean() > 0.93
    again = nbsvm.fit(docs.repartition(5), labels.repartition(3))
    assert np.allclose(model.weights, again.weights) and model.slope == pytest.approx(again.slope)


def test_classifier_on_edge_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (9, 0, 1), (9, 1, 0), (None, 1, 1), (10, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = nbsvm.fit(docs, labels)
    found = nbsvm.score(docs, model)
    assert set(found.columns) == set(docs.columns)
    rows = found.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    empties = {r.score for r in rows if not r.text}
    assert len(empties) == 1
    assert nbsvm.accepted(docs, model).schema == docs.schema
    none = nbsvm.fit(docs, labels.filter("doc_id > 1000"))
    assert nbsvm.accepted(docs, none).count() == len(ROWS)
    one = nbsvm.fit(docs, labels.filter("quality = 1 AND doc_id < 5"))
    assert {r.score for r in nbsvm.score(docs, one).collect()} == {one.share}
    assert nbsvm.score(documents(spark, []), model).count() == 0
    assert nbsvm.fit(documents(spark, []), labels).n_rows == 0


def test_the_fit_is_bounded_whatever_repeats(spark):
    """One id with many texts and many copies; features of long texts."""
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(("al", "ber", "con", "dra")) for _ in range(n))
    rows = [(1, text(6), "", 0, "") for _ in range(400)] + [(2, "the same copy", "", 0, "") for _ in range(400)] + [(i, text(9), "", 0, "") for i in range(3, 60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").filter(~nbsvm.held_out())
    whole = nbsvm.fit(docs, labels)
    assert whole.n_rows == len({r[:2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2})
    for bound in (1, 10, 37):
        assert nbsvm.fit(docs, labels, sample_rows=bound).n_rows <= bound
    few = nbsvm.fit(docs, labels, feature_bytes=16 * 2_000)
    assert 0 < few.n_rows < whole.n_rows
    again = nbsvm.fit(docs.repartition(3), labels, sample_rows=37)
    assert np.array_equal(again.weights, nbsvm.fit(docs.repartition(5), labels, sample_rows=37).weights)


def plain_grams(text):
    """The n-grams of a text as tuples, without hashing: bytes of orders 1 to 3 and runs of word repeats."""
    raw, found = text.encode(), text.encode().split()
    grams = {("bytes", raw[i : i + n]) for n in nbsvm.ORDERS for i in range(len(raw) - n + 1)}
    same = [a == b for a, b in zip(found, found[1:])]
    k = nbsvm.REPEAT_ORDER
    return grams | {("repeats", tuple(same[i : i + k])) for i in range(len(same) - k + 1)}


def test_scores_are_those_of_a_dense_plain_classifier(monkeypatch):
    """Log-count ratios, scaling, hinge-loss model and sigmoid over a dense matrix of unhashed n-grams."""
    monkeypatch.setattr(nbsvm, "EPOCHS", 400)
    draw = random.Random(7)
    word = lambda good: draw.choice(("alpha", "berry", "cedar") if good else ("zzz", "zz!", "zy?")) if draw.random() < 0.6 else draw.choice(("oak", "elm"))
    texts = [" ".join(word(i % 2) for _ in range(draw.randint(2, 9))) for i in range(30)]
    labels = np.array([i % 2 for i in range(30)])
    places = [np.unique(nbsvm.grams(t)) for t in texts]
    vocabulary = np.unique(np.concatenate(places))
    # Few n-grams share a place here; features are what the places say.
    assert 0.95 * len(set().union(*map(plain_grams, texts))) <= len(vocabulary) <= len(set().union(*map(plain_grams, texts)))
    dense = np.array([np.isin(vocabulary, p) for p in places], float)

    def ratios(x, y):
        # Smoothing goes to every place there is, seen or not.
        unseen = nbsvm.SMOOTHING * (nbsvm.FEATURES - len(vocabulary))
        counts = [x[y == c].sum(axis=0) + nbsvm.SMOOTHING for c in (0, 1)]
        return np.log(counts[1] / (counts[1].sum() + unseen)) - np.log(counts[0] / (counts[0].sum() + unseen))

    def margins(x, y, of):
        r = ratios(x, y)
        unit = lambda m: (m * r) / np.maximum(np.linalg.norm(m * r, axis=1, keepdims=True), 1e-300)
        a, sign = np.hstack([unit(x), np.ones((len(x), 1))]), np.where(y == 1, 1.0, -1.0)
        dual, kernel = np.zeros(len(x)), (a * sign[:, None]) @ (a * sign[:, None]).T
        for _ in range(4_000):  # the same problem by projected coordinate steps on its kernel
            for i in range(len(x)):
                dual[i] = min(max(dual[i] - (kernel[i] @ dual - 1) / kernel[i, i], 0), nbsvm.PENALTY)
        w = (dual * sign) @ a
        return np.hstack([unit(of), np.ones((len(of), 1))]) @ w

    fitted = nbsvm._fit(places, labels)
    array = lambda raw: np.frombuffer(raw, "<f4").astype(float)
    model = nbsvm.Model(30, array(fitted["ratios"]), array(fitted["weights"]), fitted["intercept"], fitted["slope"], fitted["offset"], fitted["share"])
    kept = np.arange(30) % nbsvm.CALIBRATION != 0
    seen = margins(dense[kept], labels[kept], dense[~kept])
    # The sigmoid by plain gradient steps on the smoothed targets.
    good, bad = (labels[~kept] == 1).sum(), (labels[~kept] == 0).sum()
    target, at = np.where(labels[~kept] == 1, (good + 1) / (good + 2), 1 / (bad + 2)), np.zeros(2)
    x = np.stack([seen, np.ones_like(seen)], axis=1)
    for _ in range(200_000):
        at -= 0.05 * x.T @ (1 / (1 + np.exp(-(x @ at))) - target)
    want = 1 / (1 + np.exp(-(at[0] * margins(dense, labels, dense) + at[1])))
    assert np.abs(model.scores(texts) - want).max() < 2e-3


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(nbsvm, "EPOCHS", 200)
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 40, 12)) for _ in range(60)]
    values, signs = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows], np.where(draw.random(60) < 0.5, 1.0, -1.0)
    weights, intercept = nbsvm.descend(rows, values, signs)
    full = np.zeros((60, 41))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        full[i, r], full[i, 40] = v, 1.0
    loss = lambda w: 0.5 * w @ w + nbsvm.PENALTY * np.maximum(0, 1 - signs * (full @ w)).sum()
    ours, best = np.append(weights[:40], intercept), np.zeros(41)
    for step in range(1, 20_001):
        wrong = signs * (full @ best) < 1
        best = best - (best - nbsvm.PENALTY * (signs[wrong, None] * full[wrong]).sum(axis=0)) / (step + 10)
    assert loss(ours) <= loss(best) * 1.02


def brute_scores(rows, wanted, size):
    chars = {}
    for _, text, *_ in rows:
        for c in text or "":
            chars[c] = chars.get(c, 0) + 1
    ids = {c: i + 2 for i, c in enumerate(sorted(chars, key=lambda c: (-chars[c], c))[: size - 2])}
    tokens = lambda t: [0, 0, *[ids.get(c, 1) for c in t or ""], 0]
    out = []
    sides = [wanted, [r for r in rows if r not in wanted]]
    totals = [sum(len(r[1] or "") + 1 for r in part) for part in sides]
    for part, own in zip(sides, totals, strict=True):
        three, weight = {}, min(totals) / max(own, 1)
        for _, text, *_ in part:
            t = tokens(text)
            for g in zip(t, t[1:], t[2:], strict=False):
                three[g] = three.get(g, 0) + weight
        two, one, context2, context1 = {}, {}, {}, {}
        for (a, b, c), n in three.items():
            for table, k in ((two, (b, c)), (one, c), (context2, (a, b)), (context1, b)):
                table[k] = table.get(k, 0) + n
        total = sum(one.values())
        prior = lm_score.PRIOR

        def loss(a, b, c):
            p1 = (one.get(c, 0) + 1) / (total + size)
            p2 = (two.get((b, c), 0) + prior * p1) / (context1.get(b, 0) + prior)
            return -np.log((three.get((a, b, c), 0) + prior * p2) / (context2.get((a, b), 0) + prior))

        out.append([np.mean([loss(*g) for g in zip(t, t[1:], t[2:], strict=False)]) for t in (tokens(r[1]) for r in rows)])
    return out


def test_language_model_scores_against_brute_force(spark):
    size, docs = 12, documents(spark)
    wanted = [r for r in ROWS if r[0] in (8, 9, 12)]
    ids = spark.createDataFrame([(8,), (9,), (12,), (77,)], "doc_id long")
    found = lm_score.score(docs, *lm_score.fit(docs, ids, size), size).collect()
    ours, theirs = brute_scores(ROWS, wanted, size)
    want = sorted((repr(r[:2]), len(r[1] or "") + 1, a, b) for r, a, b in zip(ROWS, ours, theirs, strict=True))
    got = sorted((repr((r.doc_id, r.text)), r.n_tokens, r.target_loss, r.background_loss) for r in found)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])
    assert all(r.score == r.target_loss - r.background_loss for r in found)


def test_language_model_of_nothing(spark):
    none = documents(spark, [])
    ids = spark.createDataFrame([], "doc_id long")
    assert lm_score.score(none, *lm_score.fit(none, ids)).count() == 0
    docs = documents(spark)
    every = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    for chosen, rows in ((ids, docs), (every, docs.filter("doc_id IS NOT NULL"))):
        found = lm_score.score(docs, *lm_score.fit(rows, chosen)).collect()
        assert len(found) == len(ROWS) and all(r.score == 0 for r in found)
        assert np.allclose([r.target_loss for r in found], np.log(lm_score.VOCABULARY))


def test_a_side_of_many_copies_is_matched_in_size(spark):
    """The same texts on both sides, one of them forty times over: no side is preferred."""
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdef ") for _ in range(60)) for _ in range(10)]
    rows = [(i, t, "", 0, "") for i, t in enumerate(texts)] + [(100 + i, t, "", 0, "") for i, t in enumerate(texts * 40)]
    docs, ids = documents(spark, rows), spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    assert all(abs(r.score) < 1e-9 for r in lm_score.score(docs, *lm_score.fit(docs, ids)).collect())


def test_language_model_knows_every_character(spark):
    draw = random.Random(8)
    rare = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, "".join(draw.choice(rare) for _ in range(40)), "", 0, "") for i in range(20)]
    rows += [(30, "\U0010ffff\x00" * 3, "", 0, ""), (31, None, "", 0, ""), *[(40 + i, "a plain text " * 20, "", 0, "") for i in range(3)]]
    docs, ids = documents(spark, rows), spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    found = {r.doc_id: r for r in lm_score.score(docs, *lm_score.fit(docs, ids)).collect()}
    size = len({c for r in rows for c in r[1] or ""}) + 2
    assert size > lm_score.VOCABULARY
    ours, theirs = brute_scores(rows, rows[:3], size)
    assert np.allclose([found[r[0]].target_loss for r in rows], ours) and np.allclose([found[r[0]].background_loss for r in rows], theirs)
    assert len({round(found[i].score, 9) for i in range(20)}) == 20
    other = documents(spark, [(1, rows[0][1][:20] + "\u0416\u0416", "", 0, "")])
    assert lm_score.score(other, *lm_score.fit(docs, ids)).first().target_loss > 0


def test_language_model_in_small_blocks(spark, monkeypatch):
    docs, ids = documents(spark), spark.createDataFrame([(8,), (12,)], "doc_id long")
    key = lambda r: repr((r.doc_id, r.text, r.k0, r.score))
    want = sorted(lm_score.score(docs, *lm_score.fit(docs, ids)).collect(), key=key)
    monkeypatch.setattr(lm_score, "BLOCK", 300)
    monkeypatch.setattr(lm_score, "HELD", 50)
    found = sorted(lm_score.score(docs, *lm_score.fit(docs, ids)).collect(), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want])
