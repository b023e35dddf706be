"""Whitening of embeddings: blockwise QR, bidiagonal form, qd singular values, twisted factorisations.

Entries c of a vector become the integers ``x = floor(SCALE * c) + SHIFT``. Their sums are exact. Tasks fold
the centred rows ``(n * x - S) / n`` of a partition into a triangle by QR, block after block, and triangles are
folded ``FAN`` at a time until one is left: R, with R'R the covariance times n. No covariance matrix is
formed. Householder reflections make R bidiagonal; a differential qd iteration with shifts that never pass
the least value finds the squared singular values; each right vector comes out of the twisted factorisation
whose twist has the least pivot, and is led back through the reflections. These are the components, by falling
eigenvalue; the largest entry of a component is positive.

A triangle has as many rows and columns as a vector has entries, so what a fold holds is bounded by the
dimension: ``FAN`` triangles. The model that comes to the driver is one triangle's worth of vectors.

A null vector, or one with a null or non-finite entry, takes no part and gets no row. Vectors shorter than the
longest one end in zeros. A null id stays null; repeated ids and rows count as often as they are there.
``floor(SCALE * c)`` is held within +-``MOST``. A deviation beyond a long reads as the largest long. Components
without variance to double precision (constant or dependent entries, a single row) are left out, so an empty
or constant table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.vectors import finite, scaled

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Triangles that one fold takes.
FAN = 8
#: Rows of a partition that one QR takes.
BLOCK = 4_096
_EPS = float(np.finfo(float).eps)
_LONGEST = (1 << 63) - 1


# Singular values and vectors of a triangle.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right basis V of the upper bidiagonal form: ``r = U B V'``."""
    a, d = np.array(r, float), r.shape[1]
    basis = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, norm = x.copy(), float(np.linalg.norm(x))
        v[0] += np.copysign(norm, x[0])
        square = float(v @ v)
        return v, 2.0 / square if square else 0.0

    for k in range(d):
        v, scale = reflector(a[k:, k])
        a[k:, k:] -= scale * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, scale = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= scale * np.outer(a[k:, k + 1 :] @ v, v)
            basis[:, k + 1 :] -= scale * np.outer(basis[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by differential qd steps with shifts.

    Without a shift the step's pivots d are the inverses of the diagonal of (B B')^-1, so ``1 / sum(1 / d)`` is a
    lower bound of the least squared value and a shift by it keeps all pivots positive. A shift that rounding
    made too large is halved. A value is split off where its coupling is nothing beside it.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found: list[float] = []
    pending = [(q, e, 0.0)]
    while pending:
        q, e, moved = pending.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (_EPS * _EPS / 16) * (moved + min(q[i], q[i + 1])) or e[i] < 1e-290), None)
            if cut is not None:
                pending.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if q[0] < q[-1]:  # large values first: small ones then leave at the end
                q, e = _reversed(q, e)
            shift = _least_bound(q, e) * (1 - 16 * _EPS)
            while (step := _qd(q, e, shift)) is None:
                shift = shift / 2 if shift > _EPS * (moved + min(q)) else 0.0
            (q, e), moved = step, moved + shift
    return np.sort(np.array(found))[::-1]


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The array of the matrix turned by the antidiagonal, which has the same values."""
    return q[::-1], e[::-1]


def _least_bound(q: list[float], e: list[float]) -> float:
    d, total = q[0], 0.0
    for i in range(len(e)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        d *= q[i + 1] / (d + e[i])
    return 1.0 / (total + 1.0 / d) if d > 0.0 and np.isfinite(total + 1.0 / d) else 0.0


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step of the differential qd algorithm; None if a pivot turns negative."""
    d, qs, es = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        now = d + e[i]
        ratio = q[i + 1] / now
        qs.append(now)
        es.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0.0:
        if shift or d != d:
            return None
        d = 0.0
    return [*qs, d], es


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float):
    """Factors of ``B'B - value`` from the top and from the bottom, and the pivot of a twist at each row.

    Without a row exchange: lower multipliers, upper multipliers, pivots.
    """
    n = len(diagonal)
    square, ratio = diagonal**2, above / diagonal[:-1]
    tiny = _EPS * _EPS * float(np.max(square))
    lower, upper, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + square[i] or tiny
        lower[i] = square[i] * ratio[i] / pivot
        s[i + 1] = lower[i] * ratio[i] * s[i] - value
    p[-1] = square[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = square[i] * ratio[i] ** 2 + p[i + 1] or tiny
        upper[i] = ratio[i] * square[i] / pivot
        p[i] = p[i + 1] * (square[i] / pivot) - value
    return lower, upper, s + p + value


def _from_twist(lower: np.ndarray, upper: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(lower))
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, len(z) - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right vectors of the bidiagonal matrix for these squared singular values, as columns.

    Values closer than ``1e-3`` of themselves are a cluster: there a vector is freed of those found
    before it, and where a twist gives one of them again, the next best twist is taken.
    """
    top = float(np.max(np.abs(np.concatenate([diagonal, above])))) or 1.0
    diagonal = np.where(np.abs(diagonal) < _EPS * top, _EPS * top, diagonal)
    out: list[np.ndarray] = []
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * value:
            first = i
        lower, upper, pivots = twisted(diagonal, above, float(value))
        best, most = None, -1.0
        for at in np.argsort(np.abs(np.nan_to_num(pivots, nan=np.inf)), kind="stable"):
            z = _from_twist(lower, upper, int(at))
            left = z
            for _ in range(2):
                for other in out[first:]:
                    left = left - (other @ left) * other
            norm = float(np.linalg.norm(left))
            if norm > most:
                best, most = left / (norm or 1.0), norm
            if norm > 0.1:
                break
        out.append(best)
    return np.array(out).T.reshape(len(diagonal), len(values))


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of r'r (at most ``most``) and their unit eigenvectors as columns."""
    d = r.shape[1]
    square = np.zeros((max(d, len(r)), d))
    square[: len(r)] = r
    diagonal, above, basis = bidiagonal(square)
    values = squared_singular_values(diagonal, above)
    values = values[values > (max(d, 1) * _EPS) ** 2 * values[:1].sum()][:most]
    vectors = basis @ right_vectors(diagonal, above, values)
    heads = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(values))]
    return values, vectors * np.where(heads < 0, -1.0, 1.0)


# On Spark.


@dataclass(frozen=True)
class Model:
    """Rows of the fit list, exact sums by entry, eigenvalues of the covariance, components as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return _offsets(x, self.n, self.sums)


def _offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    wide = n * (MOST + SHIFT) >= 1 << 62 and n * int(np.abs(x).max(initial=0)) >= 1 << 62
    x = x.astype(object) if wide else x
    return x * n - np.array(sums, object if wide else np.int64)


def _deviation(offsets: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exactly, up to the largest long."""
    if offsets.dtype != object and offsets.size and float(np.abs(offsets).max()) ** 2 * offsets.shape[1] < 1 << 62:
        return (offsets * offsets).sum(axis=1)
    wide = offsets.astype(object)
    return np.array([min(int(v), _LONGEST) for v in (wide * wide).sum(axis=1)] if offsets.shape[1] else np.zeros(len(offsets)), np.int64)


def _entries(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column, width, SCALE, MOST) + SHIFT


def _fit_list(embeddings: DataFrame, vector: str) -> DataFrame:
    return embeddings.filter(finite(vector)).select(F.col(vector).cast("array<double>").alias("vector"))


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums by entry; a task sends one row of sums for each batch."""
    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column(0)
            width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
            total = _entries(column, width).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(column)], pa.int64()), "sums": pa.array([total], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(task, "n long, sums array<long>")
    wide = F.col("total").cast("decimal(38,0)")
    by_entry = parts.select("n", F.posexplode_outer("sums").alias("entry", "total")).groupBy("entry").agg(F.sum("n").alias("n"), F.sum(wide).alias("total"))
    found = {row["entry"]: (row["n"], int(row["total"] or 0)) for row in by_entry.collect()}  # one row for each entry of a vector
    n = found.pop(None, (0, 0))[0] + found.get(0, (0, 0))[0]  # batches of empty vectors only, and all others
    # A batch without long vectors has none of the later entries: they are zeros there.
    return n, tuple(total + SHIFT * (n - rows) for _, (rows, total) in sorted(found.items()))


def _triangles(rows: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """(part, r): one triangle for each partition that has rows."""
    def task(batches: Iterator[pa.RecordBatch]):
        r = np.zeros((0, len(sums)))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = _entries(batch.column(0).slice(start, BLOCK), len(sums))
                r = np.linalg.qr(np.vstack([r, (_offsets(x, n, sums) / n).astype(float)]), mode="r")
        if len(r):
            yield _triangle_row(TaskContext.get().partitionId(), r)

    return rows.mapInArrow(task, "part long, r binary")


def _triangle_row(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})


def _folded(group: pa.Table, width: int) -> tuple[int, np.ndarray]:
    rows = sorted(zip(group.column("part").to_pylist(), group.column("r").to_pylist(), strict=True))
    r = np.zeros((0, width))
    for _, raw in rows:
        r = np.linalg.qr(np.vstack([r, np.frombuffer(raw).reshape(-1, width)]), mode="r")
    return rows[0][0], r


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The components of all vectors that take part."""
    rows = _fit_list(embeddings, vector)
    n, sums = _sums(rows)
    width = len(sums)
    nothing = Model(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    if not n or not width:
        return nothing
    triangles, parts = _triangles(rows, n, sums), rows.rdd.getNumPartitions()

    def fold(group: pa.Table) -> pa.Table:
        part, r = _folded(group, width)
        return pa.Table.from_batches([_triangle_row(part // FAN, r)])

    while parts > FAN:
        triangles = triangles.groupBy(F.floor(F.col("part") / FAN).alias("fold")).applyInArrow(fold, "part long, r binary")
        parts = -(-parts // FAN)

    def solve(group: pa.Table) -> pa.Table:
        _, r = _folded(group, width)
        values, vectors = principal(r, components)
        return pa.Table.from_pydict({
            "values": pa.array([values.tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "square": pa.array([float((r * r).sum())], pa.float64()),
            "error": pa.array([_identity_error(r, values, vectors)], pa.float64()),
        })

    row = triangles.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "values binary, vectors binary, square double, error double").first()
    values = np.frombuffer(bytes(row["values"]))
    vectors = np.frombuffer(bytes(row["vectors"])).reshape(width, len(values))
    return Model(n, sums, values / n, vectors, row["square"] / n, row["error"])


def _identity_error(r: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity; r'r is the rows' own."""
    white = r @ vectors / np.sqrt(values)
    return float(np.abs(white.T @ white - np.eye(len(values))).max(initial=0.0))


def whiten(embeddings: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: its whitened coordinate and the component's share."""
    rows = embeddings.filter(finite(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    found = len(model.values)
    explained = model.values / (model.trace or 1.0)

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows if found else 0, BLOCK):
                part = batch.slice(start, BLOCK)
                offsets = model.offsets(_entries(part.column(1), len(model.sums)))
                white = (offsets / model.n).astype(float) @ model.vectors / np.sqrt(model.values)
                rows = part.num_rows
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(rows), found))),
                    "component": pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * found, model.n, np.int64)),
                    "deviation": pa.array(np.repeat(_deviation(offsets), found)),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * found, model.identity_error)),
                })

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(task, schema)
