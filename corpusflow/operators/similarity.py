"""Similarity of model states inside bounded batches, and the losses built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions import arrays as A
from corpusflow.operators.aggregates import log_sum_exp

#: Norms are kept above this, so zero vectors score 0.
_NORM_FLOOR = 1e-8


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[:, None, :] - y[None, :, :]


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = lambda m: np.maximum(np.linalg.norm(m, axis=1), _NORM_FLOOR)
    return x @ y.T / (norm(x)[:, None] * norm(y)[None, :])


def _smooth_l1(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.abs(_differences(x, y))
    return -np.where(d < 1, 0.5 * d * d, d - 0.5).sum(axis=2)


#: Every row of one matrix against every row of the other. Norms and products are those of whole matrices.
METRICS = {
    "cosine": _cosine,
    "l1": lambda x, y: -np.abs(_differences(x, y)).sum(axis=2),
    "l2": lambda x, y: -(_differences(x, y) ** 2).sum(axis=2),
    "smoothl1": _smooth_l1,
    "dot": lambda x, y: x @ y.T,
}


def _batched(df: DataFrame, batch_rows: int, side: str) -> DataFrame:
    """(batch, rows): the (position, vector) pairs of a batch, at most ``batch_rows`` of them.

    ``pos`` is unique; a position that comes twice fails the job, for batches would not be bounded.
    """
    pos = F.col("pos").cast("bigint")
    row = F.struct(F.pmod(pos, F.lit(batch_rows)).cast("bigint").alias(side), F.col("vec").alias(f"_{side}"))
    rows = df.groupBy(F.floor(pos / batch_rows).cast("bigint").alias("batch")).agg(
        F.collect_list(row).alias(side), F.count(F.lit(1)).alias("_rows")
    )
    message = F.concat(F.lit("a position repeats: batches would not be bounded, in batch "), F.col("batch").cast("string"))
    ok = F.when(F.col("_rows") > batch_rows, F.raise_error(message).cast("boolean")).when(
        F.size(F.array_distinct(F.col(side)[side])) < F.col("_rows"), F.raise_error(message).cast("boolean")
    )
    return rows.filter(ok.otherwise(F.lit(True))).drop("_rows")


def pair_similarity(x1: DataFrame, x2: DataFrame, *metrics: str, batch_rows: int = 32) -> DataFrame:
    """Similarity of every row i of ``x1`` with every row j of ``x2`` in the same batch, by each metric.

    Both sides hold (pos, vec). A batch is a run of ``batch_rows`` positions, so each row meets at
    most that many others however the table grows; a batch is two matrices in an Arrow task. Vectors of unequal lengths, or with
    a null, have no score. With one metric (cosine if none is named) the
    column is ``similarity``, with several each has the metric's name.
    """
    metrics = metrics or ("cosine",)
    names = ["similarity"] if len(metrics) == 1 else list(metrics)
    joined = _batched(x1, batch_rows, "i").join(_batched(x2, batch_rows, "j"), "batch")
    doubles = lambda side: F.transform(side, lambda row: F.struct(row[side].alias("at"), row[f"_{side}"].cast("array<double>").alias("vec")))

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                yield _pairs_of(batch.column(0)[k].as_py(), *[_sides(batch.column(c)[k].values) for c in (1, 2)], metrics, names)

    schema = ", ".join(["batch long", "i long", "j long", *[f"{n} double" for n in names]])
    return joined.select("batch", doubles("i").alias("i"), doubles("j").alias("j")).mapInArrow(task, schema)


def _sides(rows: pa.StructArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Positions of a side, and by vector length the rows that have it and their matrix. Vectors with a null are in none."""
    at, vectors = rows.field("at").to_numpy(zero_copy_only=False), rows.field("vec")
    whole = [k for k, v in enumerate(vectors) if v.is_valid and v.values.null_count == 0]
    by_length: dict[int, list[int]] = {}
    for k in whole:
        by_length.setdefault(len(vectors[k]), []).append(k)
    matrix = lambda ks: np.stack([vectors[k].values.to_numpy(zero_copy_only=False) for k in ks])
    return at, {n: (np.array(ks), matrix(ks)) for n, ks in by_length.items()}


def _pairs_of(number: int, left, right, metrics, names) -> pa.RecordBatch:
    """All pairs of a batch; those of vectors that cannot be compared have no score."""
    (i, xs), (j, ys) = left, right
    shape = (len(i), len(j))
    columns = {"batch": pa.array(np.full(i.size * j.size, number)), "i": pa.array(np.repeat(i, len(j))), "j": pa.array(np.tile(j, len(i)))}
    comparable = np.zeros(shape, bool)
    for n in xs.keys() & ys.keys():
        comparable[np.ix_(xs[n][0], ys[n][0])] = True
    for metric, name in zip(metrics, names, strict=True):
        scores = np.zeros(shape)
        for n in xs.keys() & ys.keys():
            scores[np.ix_(xs[n][0], ys[n][0])] = METRICS[metric](xs[n][1], ys[n][1])
        columns[name] = pa.array(scores.ravel(), mask=~comparable.ravel())
    return pa.RecordBatch.from_pydict(columns)


def contrastive_score(similarities: DataFrame, temperature: float = 1.0, whole: bool = True) -> DataFrame:
    """-0.5 x mean over the diagonal of (log-softmax over rows + log-softmax over columns).

    With ``whole`` False the score of each batch, which is what a training step sees.
    """
    logits = similarities.withColumn("_l", F.col("similarity") / F.lit(float(temperature)))
    axes = F.array(
        F.struct(F.lit("row").alias("axis"), F.col("i").alias("k")),
        F.struct(F.lit("column").alias("axis"), F.col("j").alias("k")),
    )
    both = logits.select("batch", "i", "j", "_l", F.explode(axes).alias("_a")).select(
        "batch", "i", "j", "_l", "_a.axis", "_a.k"
    )
    diagonal = F.when(F.col("i") == F.col("j"), F.col("_l"))
    lines = log_sum_exp(both, ["batch", "axis", "k"], F.col("_l"), _diag=diagonal)
    matched = lines.filter(F.col("_diag").isNotNull()).withColumn("_lp", F.col("_diag") - F.col("lse"))
    batches = matched.groupBy("batch").agg(
        F.sum("_lp").alias("_sum"), F.count(F.when(F.col("axis") == "row", 1)).alias("n_rows")
    )
    if not whole:
        return batches.select("batch", "n_rows", (-0.5 * F.col("_sum") / F.col("n_rows")).alias("score"))
    return batches.agg(
        F.sum("n_rows").alias("n_rows"), (-0.5 * F.sum("_sum") / F.sum("n_rows")).alias("score")
    )


def masked_mse(pairs: DataFrame, x1: str, x2: str, valid: Column) -> DataFrame:
    """Squared distance over the dimensions, averaged over unpadded positions."""
    return pairs.filter(valid).agg(
        F.avg(A.squared_distance(F.col(x1), F.col(x2))).alias("mse"), F.count(F.lit(1)).alias("n_valid")
    )
