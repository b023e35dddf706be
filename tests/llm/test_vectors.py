"""Hard negatives and whitening against brute force, and the rows that both must bear."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives, whitening
from corpusflow.llm.vectors import finite

SCHEMA = "vec_id long, embedding array<float>, label int, row long, x string, score double"
INF, NAN = float("inf"), float("nan")


def odd_rows(n=160, width=20, seed=2):
    """Ties, copies, repeated ids, short, empty, broken and huge vectors; a label that holds a third of the rows."""
    draw = random.Random(seed)
    vector = lambda w=width: [draw.gauss(0, 0.2) for _ in range(w)]
    common = vector()
    rows = [(i * 10, vector() if i % 3 else common, 1 if i % 3 == 0 else draw.randrange(10)) for i in range(n)]
    rows += [(100, common, 4), (100, vector(), 4), (100, vector(), 4), (None, vector(), 1), (None, common, 2)]
    rows += [(201, vector(3), 5), (300, [], 5), (203, None, 5), (400, [0.1, None], 5), (205, [NAN] * width, 5), (500, [INF] + [0.0] * 3, 5)]
    rows += [(207, vector(), None), (600, [0.0] * width, 6), (208, [0.0] * width, 6), (209, [1e30] * 2, 7), (700, [-1e30, 3.0], 7)]
    return [(*r, i, "x", None) for i, r in enumerate(rows)]


def whole(vector, width, scale, most):
    return [int(max(-most, min(most, math.floor(scale * float(np.float32(c)))))) for c in vector] + [0] * (width - len(vector))


def taking_part(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_negatives(rows):
    rows = [r for r in taking_part(rows) if r[2] is not None]
    width = max((len(r[1]) for r in rows), default=0)
    most = min((1 << 31) - 1, math.isqrt((1 << 62) // max(width, 1)))
    held = []
    for vec_id, vector, label, *_ in rows:
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        held.append((vec_id, moved, whole(vector, width, 256, most)))
    out = []
    late = lambda i: (i is None, i)
    for a, (anchor, label, x) in enumerate(held):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), late(i), i, other) for b, (i, other, y) in enumerate(held) if b != a]
        scored.sort(key=lambda r: r[:2])
        for score, _, positive, _ in [r for r in scored if r[3] == label][:5]:
            found = [r for r in scored if r[3] != label and 80 * -score <= 100 * -r[0] <= 100 * -score][:5]
            out += [(anchor, positive, k, r[2], -score, -r[0]) for k, r in enumerate(found, 1)]
    return out


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hard_negatives.mine(df, moved, F.col("vec_id") % 100 == 0).collect()]


@pytest.mark.parametrize("blocks", [None, 7])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(hard_negatives, "BLOCK", blocks)
    rows = odd_rows()
    found = mined(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(found, key=repr) == sorted(brute_negatives(rows), key=repr)


def test_negatives_of_degenerate_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [], 1, 0, "", 0.0), (101, [], 1, 0, "", 0.0), (102, [], 2, 0, "", 0.0)], SCHEMA)) == [(100, 101, 1, 102, 0, 0)]
    assert mined(spark.createDataFrame([(200, [1.0], 1, 0, "", 0.0)], SCHEMA)) == []


@pytest.mark.parametrize("width", [1, 63, 64, 65, 130])
def test_intervals_hold_the_true_score_and_narrow_from_level_to_level(width):
    draw = np.random.default_rng(width)
    x = draw.integers(-200, 200, (300, width))
    x[0], x[1] = 0, x[2]
    codes, steps, rests = hard_negatives.encode(x)
    assert (np.diff(rests, axis=1) <= 1e-9).all()
    block = object.__new__(hard_negatives.Block)
    block.steps, block.rests, block.codes, block.width = steps, rests, codes, width
    block.length = np.linalg.norm(x.astype(float), axis=1)
    q = draw.integers(-200, 200, width)
    true, widths = x @ q, []

    def narrow(low, high):
        assert (low <= true).all() and (true <= high).all()
        widths.append((high - low).mean())
        return np.ones(len(low), bool)

    query = hard_negatives.Query(q, q.astype(float) @ hard_negatives._rotation(width))
    assert len(block.survivors(query, np.arange(len(x)), narrow)) == len(x)
    assert len(widths) == hard_negatives.LEVELS and widths == sorted(widths, reverse=True)


def test_codes_spare_most_integer_scores():
    """On a table with near neighbours few rows are left to score."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 64))
    x = np.floor(256 * (centres[draw.integers(0, 40, 4_000)] + 0.05 * draw.normal(size=(4_000, 64)))).astype(np.int64)
    codes, steps, rests = hard_negatives.encode(x)
    block = object.__new__(hard_negatives.Block)
    block.steps, block.rests, block.codes, block.width, block.length = steps, rests, codes, 64, np.linalg.norm(x.astype(float), axis=1)
    query = hard_negatives.Query(x[0], x[0].astype(float) @ hard_negatives._rotation(64))
    left = block.survivors(query, np.arange(1, len(x)), lambda low, high: hard_negatives._at_least_best(low, high, 5))
    best = set((1 + np.argsort(-(x[1:] @ x[0]), kind="stable"))[:5].tolist())
    assert best <= set(left.tolist()) and len(left) < len(x) // 10


def test_finite(spark):
    df = spark.createDataFrame([([1.0], 1), ([], 1), (None, 0), ([None], 0), ([NAN], 0), ([-INF], 0)], "v array<double>, want int")
    assert all(r.got == bool(r.want) for r in df.select("want", finite("v").alias("got")).collect())


MATRICES = {
    "plain": lambda d: d.normal(size=(400, 24)),
    "graded": lambda d: d.normal(size=(400, 24)) * np.logspace(0, -5, 24),
    "rising": lambda d: d.normal(size=(400, 24)) * np.logspace(-5, 0, 24),
    "dependent": lambda d: np.repeat(d.normal(size=(400, 6)), 4, axis=1),
    "equal": lambda d: np.linalg.qr(d.normal(size=(100, 24)))[0],
    "identity": lambda d: np.eye(9),
    "cluster": lambda d: np.linalg.qr(d.normal(size=(90, 24)))[0] * np.r_[np.ones(12), np.full(12, 1 + 1e-11)] @ np.linalg.qr(d.normal(size=(24, 24)))[0],
    "pairs": lambda d: np.diag(np.abs(np.arange(21) - 10.0) + 11) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    "zero": lambda d: np.zeros((4, 3)),
    "short": lambda d: d.normal(size=(3, 8)),
    "single": lambda d: d.normal(size=(5, 1)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_principal_values_and_vectors(name):
    r = MATRICES[name](np.random.default_rng(3))
    values, vectors = whitening.principal(r, r.shape[1])
    true = np.linalg.svd(r, compute_uv=False) ** 2
    rank = int((true > 1e-26 * true[0]).sum()) if true[0] else 0
    assert len(values) == rank
    # Householder reflections are exact to the norm; the qd iteration keeps what they leave.
    assert np.abs(values - true[:rank]).max(initial=0) <= 1e-13 * (true[0] or 1)
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max(initial=0) <= 1e-12 * (true[0] or 1)
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max(initial=0) <= 1e-10


def test_qd_keeps_tiny_singular_values_to_full_accuracy():
    """An upper bidiagonal matrix graded over forty orders: its determinant and its norm say what the values must give."""
    diagonal, above = np.array([1.0, 1e-10, 1e-20]), np.array([1.0, 1e-10])
    values = whitening.squared_singular_values(diagonal, above)
    assert abs(np.prod(np.sqrt(values)) / np.prod(diagonal) - 1) < 1e-13
    assert abs(values.sum() / ((diagonal**2).sum() + (above**2).sum()) - 1) < 1e-14


def brute_whitened(rows):
    rows = taking_part(rows)
    width = max((len(r[1]) for r in rows), default=0)
    x = np.array([whole(r[1], width, 64, whitening.MOST) for r in rows], object).reshape(len(rows), width) + whitening.SHIFT
    n = len(rows)
    offsets = n * x - x.sum(axis=0)
    centred = (offsets / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return rows, n, offsets, centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("block,fan", [(whitening.BLOCK, whitening.FAN), (3, 2)])
def test_whitening_of_odd_rows(spark, monkeypatch, block, fan):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", fan)
    rows = [r for r in odd_rows() if r[1] is None or not any(c is not None and math.isfinite(c) and abs(c) > 1e9 for c in r[1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = whitening.fit(df)
    found = whitening.whiten(df, model).toPandas()
    kept, n, offsets, centred, values, vectors = brute_whitened(rows)
    assert len(found) == n * 20 and set(found["n"]) == {n} and set(found["component"]) == set(range(1, 21))
    white = centred @ vectors / np.sqrt(values)
    sign = np.sign((model.vectors * vectors).sum(axis=0))
    name = lambda i: -1 if i is None or i != i else int(i)
    want = sorted((name(r[0]), int((o * o).sum()), *np.round(w * sign, 6)) for r, o, w in zip(kept, offsets, white))
    got = []
    for (vec_id, deviation), group in found.fillna({"vec_id": -1}).groupby(["vec_id", "deviation"]):
        per = group.sort_values("component", kind="stable")["whitened"].to_numpy().reshape(20, -1).T
        got += [(int(vec_id), int(deviation), *np.round(w, 6)) for w in per]
    assert len(got) == len(want) and np.allclose(np.array(sorted(got), float), np.array(want, float), atol=3e-6)
    assert np.allclose(np.sort(found["explained"].unique())[::-1], values / values.sum(), rtol=1e-9)
    all_white = (np.array([list(o) for o in offsets], float) / n) @ model.vectors / np.sqrt(model.values)
    direct = np.abs(all_white.T @ all_white / n - np.eye(20)).max()
    assert found["identity_error"].nunique() == 1 and abs(found["identity_error"][0] - direct) < 1e-9 and direct < 1e-9


def test_whitening_of_degenerate_tables(spark):
    make = lambda vectors: spark.createDataFrame([(i, v, 1, i, "", 0.0) for i, v in enumerate(vectors)], SCHEMA)
    white = lambda vectors: whitening.whiten(make(vectors), whitening.fit(make(vectors))).collect()
    assert white([]) == [] and white([[1.0, 2.0]]) == [] and white([[1.0]] * 5) == [] and white([[], []]) == [] and white([None]) == []
    two = white([[1.0, 0.0], [3.0]])
    assert [(r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9), round(r.explained, 9)) for r in two] == [
        (0, 1, 2, 128**2, -1.0, 1.0), (1, 1, 2, 128**2, 1.0, 1.0)
    ]
    huge = white([[1e30, 0.0], [-1e30, 1.0], [0.0, 5.0]])
    assert len(huge) == 6 and max(r.deviation for r in huge) == (1 << 63) - 1 and all(math.isfinite(r.whitened) for r in huge)
