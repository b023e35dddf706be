"""A quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of its byte n-grams (orders ``ORDERS``) and of the n-grams of its word
repeats (whether a word equals the one before), hashed to ``FEATURES`` places. Each indicator is scaled by the
log ratio of its smoothed counts in the two classes, vectors are scaled to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent. A sigmoid fitted on a part that the fit has not seen
turns margins into scores from 0 to 1.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, chosen by hashes of id and text, and of those at most as many as have
``FEATURE_BYTES`` of features; rows that repeat id and text are one. It runs in one task. Scoring
covers every row and the whole text, in independent tasks that hold only the model (2 MB).

A null text is empty; an empty text has no feature and gets the score of the intercept. Null labels and
null ids are not learnt from. An id labelled more than once has its lowest label. Without labelled rows all
scores are 1; with one class only, all are its smoothed share. Further columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import slices, text_of

SAMPLE_ROWS = 16_384
#: Bytes that the features of the sample may take, by an upper bound for each text.
FEATURE_BYTES = 1 << 30
ORDERS = (1, 2, 3)
REPEAT_ORDER = 4
FEATURES = 1 << 18
SMOOTHING = 1.0
PENALTY = 4.0
EPOCHS = 12
#: One row in so many of the sample is kept for the sigmoid.
CALIBRATION = 4
THRESHOLD = 0.7

_FIRST = np.uint32(2654435761)
_MODEL = "n_rows long, ratios binary, weights binary, intercept double, slope double, offset double, share double"


def _hashed(values: np.ndarray, order: int) -> np.ndarray:
    return (values * _FIRST + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - FEATURES.bit_length() + 1)


def grams(text: str) -> np.ndarray:
    """The places of all n-grams of a text, with repeats."""
    raw = text.encode()
    held = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = []
    for order in ORDERS:
        if len(held) >= order:
            codes = np.zeros(len(held) - order + 1, np.uint32)
            for j in range(order):
                codes = codes * np.uint32(257) + held[j : len(held) - order + 1 + j] + np.uint32(1)
            out.append(_hashed(codes, order))
    found = raw.split()
    same = np.fromiter(map(eq, found, found[1:]), np.uint32, max(0, len(found) - 1))
    if len(same) >= REPEAT_ORDER:
        codes = sum(same[j : len(same) - REPEAT_ORDER + 1 + j] << np.uint32(j) for j in range(REPEAT_ORDER))
        out.append(_hashed(codes.astype(np.uint32), 100 + REPEAT_ORDER))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _scaled(ratios: np.ndarray, places: np.ndarray) -> np.ndarray:
    values = ratios[places]
    return values / (np.linalg.norm(values) or 1.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model by dual coordinate descent."""
    weights, intercept = np.zeros(FEATURES), 0.0
    duals, curvature = np.zeros(len(rows)), np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (values[i] @ weights[rows[i]] + intercept) - 1.0
            dual = min(max(duals[i] - gradient / curvature[i], 0.0), PENALTY)
            if dual != duals[i]:
                step = (dual - duals[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                intercept += step
                duals[i] = dual
    return weights, intercept


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.full(FEATURES, SMOOTHING) for _ in range(2)]
    for places, label in zip(rows, labels, strict=True):
        counts[label][places] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def sigmoid_of(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid, by Newton steps on smoothed targets."""
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, at = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-6 * at @ at)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target) + 2e-6 * at)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


@dataclass(frozen=True)
class Model:
    n_rows: int
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float
    share: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.share)
        margins, last = np.full(len(texts), self.intercept), np.empty(FEATURES, np.int32)
        for i, text in enumerate(texts):
            places = grams(text or "")
            if len(places):
                order = np.arange(len(places), dtype=np.int32)
                last[places] = order
                places = places[last[places] == order]
                ratios = self.ratios[places]
                margins[i] += float(ratios @ self.weights[places]) / (float(np.sqrt(ratios @ ratios)) or 1.0)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    good = int(labels.sum())
    share = (good + 1) / (len(labels) + 2) if len(labels) else 1.0
    out = {"n_rows": len(labels), "ratios": b"", "weights": b"", "intercept": 0.0, "slope": 0.0, "offset": 0.0, "share": share}
    if not 0 < good < len(labels):
        return out

    def model(chosen: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
        part = [rows[i] for i in chosen]
        ratios = log_ratios(part, labels[chosen])
        return ratios, *descend(part, [_scaled(ratios, p) for p in part], np.where(labels[chosen] == 1, 1.0, -1.0))

    kept = [i for i in range(len(rows)) if i % CALIBRATION]
    seen = [i for i in range(len(rows)) if not i % CALIBRATION]
    if len(set(labels[kept].tolist())) == 2 and len(seen) > 1:
        ratios, weights, intercept = model(kept)
        margins = np.array([_scaled(ratios, rows[i]) @ weights[rows[i]] + intercept for i in seen])
        out["slope"], out["offset"] = sigmoid_of(margins, labels[seen])
    else:
        out["slope"] = 1.0
    ratios, weights, out["intercept"] = model(list(range(len(rows))))
    return out | {"ratios": ratios.astype("<f4").tobytes(), "weights": weights.astype("<f4").tobytes()}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, feature_bytes: int = FEATURE_BYTES) -> Model:
    """The model from labelled rows that are not held out."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        (F.min("quality") > 0).cast("int").alias("label")
    )
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select("doc_id", text_of("text").alias("text"))
    labelled = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).withColumn("text_key", F.xxhash64("text"))
    # An id may come many times: what is taken of the labelled rows is settled on narrow rows, one for each id and text.
    most = F.least(4 * 4 * F.octet_length("text").cast("long"), F.lit(4 * FEATURES))
    narrow = labelled.select("doc_id", "text_key", most.alias("most")).dropDuplicates(["doc_id", "text_key"])
    taken = narrow.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(sample_rows)
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    taken = taken.withColumn("upto", F.sum("most").over(upto)).filter(F.col("upto") <= feature_bytes)
    keys = taken.select("doc_id", "text_key")
    sample = labelled.join(F.broadcast(keys), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])

    def features(batches):
        for batch in slices(batches):
            found = [np.unique(grams(x.as_py())).astype("<u4").tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "features"]
            )

    def one_fit(batches):
        held = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        held.sort(key=lambda row: (zlib.crc32(str(row[0]).encode()), row))
        rows, answers = [np.frombuffer(f, "<u4") for _, _, f in held], np.array([y for _, y, _ in held], np.int64)
        yield pa.RecordBatch.from_pylist([_fit(rows, answers)], schema=_MODEL_ARROW)

    rows = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(features, "doc_id long, label int, features binary")
    row = rows.repartition(1).mapInArrow(one_fit, _MODEL).first()
    if row is None:
        return Model(0, np.zeros(0), np.zeros(0), 0.0, 0.0, 0.0, 1.0)
    array = lambda raw: np.frombuffer(bytes(raw), "<f4").astype(np.float64)
    return Model(row["n_rows"], array(row["ratios"]), array(row["weights"]), row["intercept"], row["slope"], row["offset"], row["share"])


_MODEL_ARROW = pa.schema([
    ("n_rows", pa.int64()), ("ratios", pa.binary()), ("weights", pa.binary()), ("intercept", pa.float64()),
    ("slope", pa.float64()), ("offset", pa.float64()), ("share", pa.float64()),
])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score for each row in column ``name``."""
    def task(batches):
        for batch in slices(batches):
            scores = pa.array(model.scores([x.as_py() for x in batch.column("text")]), pa.float64())
            kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != name}
            yield pa.RecordBatch.from_pydict(kept | {name: scores})

    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(task, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).filter(F.col(name) >= THRESHOLD).drop(name)
