"""Hard negatives: rotated one-bit codes, intervals that cannot miss, integer scores of what they leave.

Entries c of a vector become ``floor(SCALE * c)``; the score of two rows is their integer inner product. A vector
is rotated by a fixed orthonormal matrix and coded by the signs of its entries, one bit each. Its alignment with
that code vector and its length are stored, so the vector is ``s * b`` plus a rest orthogonal to ``b`` of known
length. The rest is coded the same way, ``LEVELS`` times; each level shortens it. A query is rotated too and cut
into ``PLANES`` bit planes, so its product with a code is a few popcounts. Cauchy-Schwarz on the rest of the last
level, on the query's part orthogonal to that code and on what the planes lost gives an interval that
holds the true score for certain; rows go from level to level while their interval can still matter, and the
rows left are scored in integers. Answers are exact, so recall is 1 by construction.

Queries meet rows in a grid of blocks: hashing deals anchors and rows to at most ``BLOCK`` a block, one cogroup
takes a pair of blocks and hands on the best few of each query, and a ranking with a limit before its shuffle
merges them. A label may be a third of all rows: blocks do not depend on labels. The codes are written to the
shared folder once and both searches start there.

Rows with a null label, a null vector, or a null or non-finite entry take no part. A null id is no anchor; as a
neighbour it comes after all others and is returned as null. Equal ids are rows of their own: each anchor row has its
answers, another row with its id is an other row. Vectors shorter than the longest end in zeros. Scaled entries are
held within a bound that keeps every score a long (2^28 for 64 entries). Other columns are not read. An empty table
gives no rows; so does an anchor without another row of its label or without a negative in range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.tables import NO_ID, row_id
from corpusflow.llm.vectors import finite, scaled, width_of
from corpusflow.session import written

SCALE = 256
LEVELS = 4
PLANES = 8
POSITIVES = NEGATIVES = 5
#: A negative scores from this many hundredths of its positive's score up to the whole of it.
LEAST = 80
#: Rows and anchors of one cell of the grid; small tables are cut finer, so that all tasks have work.
BLOCK, FINE = 65_536, 4_096
#: Part of |query| * |row| that floating-point work may be off by, well above what it is.
_SLACK = 1e-9
_CODED = "row long, vec_id long, label long, x binary, codes binary, steps binary, rests binary"


@lru_cache(maxsize=4)
def _rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((width, width)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    rows, width = bits.shape
    whole = np.zeros((rows, -(-max(width, 1) // 64) * 64), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, word), steps (row, level) and lengths of the rest (row, level) of integer rows.

    A step is alignment times length over the root of the width: the multiple of the code vector that is
    nearest to what the level codes.
    """
    rest = x.astype(float) @ _rotation(x.shape[1])
    codes, steps, rests = [], [], []
    for _ in range(levels):
        signs = np.where(rest < 0, -1.0, 1.0)
        length = np.linalg.norm(rest, axis=1)
        root = np.sqrt(max(x.shape[1], 1))
        alignment = np.divide((rest * signs).sum(axis=1), length * root, out=np.ones(len(x)), where=length > 0)
        step = alignment * length / root
        codes.append(_packed(signs > 0))
        steps.append(step)
        rest = rest - step[:, None] * signs
        rests.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, axis=1), np.stack(steps, axis=1), np.stack(rests, axis=1)


def _matrix(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """A column of equally long binary values as rows of numbers."""
    raw = table.column(name).to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), len(raw[0]) // np.dtype(kind).itemsize if raw else 0)


class Query:
    """One anchor, rotated and cut into bit planes."""

    def __init__(self, x: np.ndarray, rotated: np.ndarray) -> None:
        self.x, self.square, self.length = x, float(rotated @ rotated), float(np.linalg.norm(rotated))
        self.low = float(rotated.min(initial=0.0))
        self.step = (float(rotated.max(initial=0.0)) - self.low) / ((1 << PLANES) - 1)
        grid = np.rint((rotated - self.low) / (self.step or 1.0)).astype(np.int64)
        self.lost = float(np.linalg.norm(rotated - (self.low + self.step * grid)))
        self.planes = [_packed(((grid >> j) & 1)[None, :])[0] for j in range(PLANES)]
        self.total = len(x) * self.low + self.step * float(grid.sum())

    def product(self, codes: np.ndarray) -> np.ndarray:
        """Product with each code vector, up to what the planes lost: twice the sum over set bits, less the sum over all."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        sums = np.zeros(len(codes), np.int64)
        for j, plane in enumerate(self.planes):
            sums += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
        return 2 * (self.low * ones + self.step * sums) - self.total


class Block:
    """The coded rows of one cell."""

    def __init__(self, table: pa.Table) -> None:
        column = lambda name, kind: _matrix(table, name, kind)
        self.row, self.vec_id, self.label = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.x, self.steps, self.rests = column("x", np.int32).astype(np.int64), column("steps", float), column("rests", float)
        self.codes = column("codes", np.uint64).reshape(table.num_rows, self.steps.shape[1], -1)
        self.length = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.width = self.x.shape[1]
        most = float(np.abs(self.x).max(initial=0))
        self.small = most * most * self.width < 1 << 52
        self.real = self.x.astype(float) if self.small else None

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer scores of these rows; floating-point products stand in only where they are exact."""
        if self.small and float(np.abs(x).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * self.width < 1 << 52:
            return (self.real[at] @ x.astype(float)).astype(np.int64)
        return self.x[at] @ x

    def survivors(self, query: Query, at: np.ndarray, narrow: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows of ``at`` whose intervals ``narrow(low, high)`` keeps at every level."""
        middle = np.zeros(len(at))
        lost = np.zeros(len(at))
        root = np.sqrt(max(self.width, 1))
        for level in range(self.steps.shape[1]):
            if not len(at):
                break
            step = self.steps[at, level]
            product = query.product(self.codes[at, level])
            middle = middle + step * product
            lost = lost + np.abs(step) * root * query.lost
            along = np.maximum(np.abs(product) - root * query.lost, 0.0) / root
            across = np.sqrt(np.maximum(query.square - along * along, 0.0))
            half = self.rests[at, level] * across + lost + _SLACK * query.length * self.length[at]
            kept = narrow(middle - half, middle + half)
            at, middle, lost = at[kept], middle[kept], lost[kept]
        return at


def _at_least_best(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Rows that may be among the best ``most``: they reach the ``most``-th best certain score."""
    if len(low) <= most:
        return np.ones(len(low), bool)
    return high >= np.partition(low, len(low) - most)[len(low) - most]


def _first(vec_id: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    return np.lexsort((vec_id, -score))[:most]


def _queries(anchors: pa.Table) -> Iterator[tuple[int, int, Query]]:
    block = _matrix(anchors, "x", np.int32).astype(np.int64)
    rotated = block.astype(float) @ _rotation(block.shape[1])
    for i, (row, label) in enumerate(zip(anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), strict=True)):
        yield row, label, Query(block[i], rotated[i])


def _positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """The best rows of the anchor's own label in one cell."""
    if not anchors.num_rows or not rows.num_rows:
        return _columns([], ["anchor", "other_id", "score"])
    block = Block(rows)
    order = np.argsort(block.label, kind="stable")
    sorted_label = block.label[order]
    out: list[tuple[np.ndarray, ...]] = []
    for row, label, query in _queries(anchors):
        at = order[np.searchsorted(sorted_label, label) : np.searchsorted(sorted_label, label, "right")]
        at = block.survivors(query, at[block.row[at] != row], lambda low, high: _at_least_best(low, high, most))
        score = block.scores(query.x, at)
        best = _first(block.vec_id[at], score, most)
        out.append((np.full(len(best), row), block.vec_id[at[best]], score[best]))
    return _columns(out, ["anchor", "other_id", "score"])


def _negatives(anchors: pa.Table, rows: pa.Table, most: int, least: int) -> pa.Table:
    """For each positive score of an anchor the best rows of another label in its range, in one cell."""
    if not anchors.num_rows or not rows.num_rows:
        return _columns([], ["anchor", "positive_score", "other_id", "score"])
    block = Block(rows)
    out: list[tuple[np.ndarray, ...]] = []
    scores = anchors.column("positive_scores").to_pylist()
    for i, (row, label, query) in enumerate(_queries(anchors)):
        wanted = [(-(-least * p // 100), p) for p in scores[i]]
        bounds = list(dict.fromkeys((a, b) for a, b in wanted if a <= b))
        if not bounds:
            continue

        def narrow(low: np.ndarray, high: np.ndarray, bounds=bounds) -> np.ndarray:
            kept = np.zeros(len(low), bool)
            for a, b in bounds:
                may = (high >= a) & (low <= b)
                sure = low[may & (low >= a) & (high <= b)]
                if len(sure) > most:
                    may &= high >= np.partition(sure, len(sure) - most)[len(sure) - most]
                kept |= may
            return kept

        at = block.survivors(query, np.flatnonzero(block.label != label), narrow)
        score = block.scores(query.x, at)
        for a, b in bounds:
            inside = np.flatnonzero((score >= a) & (score <= b))
            best = inside[_first(block.vec_id[at[inside]], score[inside], most)]
            out.append((np.full(len(best), row), np.full(len(best), b), block.vec_id[at[best]], score[best]))
    return _columns(out, ["anchor", "positive_score", "other_id", "score"])


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    parts = parts or [tuple(np.zeros(0, np.int64) for _ in names)]
    return pa.Table.from_pydict({n: pa.array(np.concatenate(c).astype(np.int64), pa.int64()) for n, c in zip(names, zip(*parts, strict=True), strict=True)})


def coded(embeddings: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """The codes of all rows that take part, written; their number and the entries of the longest vector."""
    rows = embeddings.filter(finite(vector) & label.isNotNull()).select(
        row_id(key).alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    n, width = width_of(rows, "vector")
    most = min((1 << 31) - 1, isqrt((1 << 62) // max(width, 1)))

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = scaled(batch.column("vector"), width, SCALE, most)
            codes, steps, rests = encode(x)
            raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            names = ["row", "vec_id", "label", "x", "codes", "steps", "rests"]
            columns = [batch.column(c) for c in ("row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, raw(x.astype(np.int32)), raw(codes), raw(steps), raw(rests)], names)

    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "vector")
    return written(numbered.mapInArrow(task, _CODED), "codes"), n, width


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, fn, schema: str) -> DataFrame:
    """``fn`` over every pair of a block of anchors and a block of rows."""
    blocks = lambda n: max(-(-n // BLOCK), min(anchors.sparkSession.sparkContext.defaultParallelism * 4, -(-n // FINE)), 1)
    across, down = blocks(n_anchors), blocks(n_rows)
    at = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = anchors.withColumn("a", at(across)).withColumn("b", every(down))
    right = rows.withColumn("b", at(down)).withColumn("a", every(across))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(fn, schema)


def _best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` of each key, numbered; the limit acts before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)


def mine(
    embeddings: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``label`` is computed from ``embeddings``, ``anchor`` from ``vec_id`` and ``label`` of the rows that take part.
    """
    codes, n, _ = coded(embeddings, label, key, vector)
    queries = codes.filter((F.col("vec_id") != NO_ID) & anchor)
    n_queries = queries.count()
    narrow = queries.select(*[F.col(c).alias(c) for c in ("row", "label", "x")])  # names of its own: a cogroup takes both
    near = _grid(narrow, codes, n_queries, n, lambda a, r: _positives(a, r, positives), "anchor long, other_id long, score long")
    best = written(_best(near, ["anchor"], positives), "positives")
    per_anchor = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("score")).alias("positive_scores"))  # at most ``positives``
    asked = narrow.join(per_anchor, "row")
    found = _grid(asked, codes, n_queries, n, lambda a, r: _negatives(a, r, negatives, least), "anchor long, positive_score long, other_id long, score long")
    hard = _best(found, ["anchor", "positive_score"], negatives)
    ids = queries.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    named = best.select("anchor", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return named.join(hard, ["anchor", "positive_score"]).select(
        "anchor_id",
        known("positive_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        known("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
