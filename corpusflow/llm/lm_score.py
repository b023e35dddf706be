"""Cross-entropy difference of documents between a target and a background language model.

Both models are n-gram models of order 3 over one vocabulary: a boundary, an unknown symbol and every character
of the documents. The target is counted over the documents chosen by the caller, the background over all others,
so each document is counted in one model, and every document is scored by counts of which one side holds its own.
The models are matched in size: the counts of the larger side are scaled to the tokens of the smaller one before
smoothing, so that neither loses more to its prior, and no document is left out to get there. Each order is
smoothed towards the one below (weight ``PRIOR``), the lowest towards equal shares of all symbols and at least
``VOCABULARY``, in both models alike. A document's score is the mean over its tokens, end boundary included, of
the target's loss less the background's: the lower, the more it is like the target.

A trigram is one number, its cell. Tasks add up what they read and hand on sums before they hold more than
``HELD`` cells; the counts are a table of cells. To score, tasks cut the documents into blocks of about ``BLOCK``
characters; the distinct cells of each block are joined with the tables, and each block is scored with the losses
of its own cells. The driver reads three sums and no part of a model.

A caller may give a ``size``: then the vocabulary is the ``size - 2`` most frequent characters and all others are
the unknown symbol. A character that the models have not seen has no count and falls back to equal shares.

Null texts are empty; an empty text has one token, its end. Where a side has no documents there is nothing to
compare with: both models are equal shares and all scores are 0. Null and repeated ids are scored row by row. Further columns pass through; ``n_tokens``,
``target_loss``, ``background_loss`` and ``score`` replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import slices
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written

#: Symbols that the lowest order shares its prior among, at least.
VOCABULARY = 128
PRIOR = 10.0
BOUNDARY, UNKNOWN, FIRST_CHARACTER = 0, 1, 2
#: Bits of a symbol: every code point and the two symbols before them.
BITS = 21
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Cells a task adds up before it hands them on.
HELD = 1 << 20
#: Characters that are scored with one table of losses, about.
BLOCK = 4_000_000
_SIDES = ("background", "target")
_ADDED = ("n_tokens", "target_loss", "background_loss", "score")


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def character_counts(docs: DataFrame) -> DataFrame:
    """(code, n) over all documents."""
    def task(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in slices(batches):
            held = np.concatenate([np.zeros(0, "<u4"), *[_points(x.as_py()) for x in batch.column(0)]])
            found, counts = np.unique(held, return_counts=True)
            total[found] += counts
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(total[codes], pa.int64())], ["code", "n"])

    return docs.select("text").mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, size: int) -> list[int]:
    """The ``size - 2`` most frequent characters, ties by code: the shared vocabulary."""
    return [r["code"] for r in character_counts(docs).orderBy(F.desc("n"), "code").limit(size - FIRST_CHARACTER).collect()]


class Codes:
    """Texts to trigram cells; without a vocabulary every character is a symbol."""

    def __init__(self, vocabulary: list[int] | None) -> None:
        self.ids = None
        if vocabulary is not None:
            self.ids = np.full(0x110000, UNKNOWN, np.int64)
            known = np.array(vocabulary, np.int64)
            self.ids[known] = known + FIRST_CHARACTER

    def cells(self, text: str | None) -> np.ndarray:
        points = _points(text)
        ids = np.full(len(points) + 3, BOUNDARY, np.int64)
        ids[2:-1] = points.astype(np.int64) + FIRST_CHARACTER if self.ids is None else self.ids[points]
        return (ids[:-2] << 2 * BITS) | (ids[1:-1] << BITS) | ids[2:]


class Sums:
    """Counts of cells, added up in sorted arrays."""

    def __init__(self, limit: int) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, cells: np.ndarray) -> None:
        self.parts.append(np.unique(cells, return_counts=True))
        self.size += len(self.parts[-1][0])

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            cells, counts = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], counts[order]
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
            self.parts = [(cells[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def full(self) -> bool:
        """Whether more cells are held than may be, after adding up."""
        if self.size > self.limit:
            self.merge()
        return self.size > self.limit // 2


def trigram_counts(docs: DataFrame, vocabulary: list[int] | None = None) -> DataFrame:
    """(cell, background, target) over (text, in_target)."""
    def batch_of(sums: Sums, side: int) -> pa.RecordBatch:
        cells, counts = sums.merge()
        columns = [counts if i == side else np.zeros(len(cells), np.int64) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cells, *columns)], ["cell", *_SIDES])

    def task(batches):
        codes, sums = Codes(vocabulary), [Sums(HELD), Sums(HELD)]
        for batch in slices(batches):
            rows = [codes.cells(text.as_py()) for text in batch.column(0)]
            chosen = batch.column(1).to_pylist()
            for side in range(2):
                held = [r for r, w in zip(rows, chosen, strict=True) if w == bool(side)]
                if held:
                    sums[side].add(np.concatenate(held))
                if sums[side].full():
                    yield batch_of(sums[side], side)
                    sums[side] = Sums(HELD)
        for side in range(2):
            yield batch_of(sums[side], side)

    rows = docs.select("text", "in_target").mapInArrow(task, "cell long, background long, target long")
    return rows.groupBy("cell").agg(*[F.sum(s).alias(s) for s in _SIDES])


@dataclass(frozen=True)
class Model:
    """One side of a table of trigram counts; each count weighs ``weight``, ``total`` is the weight of all."""

    counts: DataFrame
    side: str
    weight: float
    total: float
    symbols: int


def fit(docs: DataFrame, target_ids: DataFrame, size: int | None = None) -> tuple[list[int] | None, Model, Model]:
    """The vocabulary (None: every character) and the models of target and background; ``target_ids`` holds distinct ``doc_id``."""
    vocabulary = None if size is None else vocabulary_of(docs, size)
    chosen = target_ids.select(F.col("doc_id").alias("target_id"))
    marked = docs.select("doc_id", "text").join(chosen.hint("shuffle_hash"), F.col("doc_id") == F.col("target_id"), "left")
    counts = written(trigram_counts(marked.select("text", F.col("target_id").isNotNull().alias("in_target")), vocabulary), "trigrams")
    last = counts.groupBy(F.col("cell").bitwiseAND(F.lit(ONE)).alias("c")).agg(*[F.sum(s).alias(s) for s in _SIDES])
    totals = last.agg(F.count_if(F.col("c") >= FIRST_CHARACTER).alias("characters"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _SIDES]).first()
    symbols = size or max(VOCABULARY, totals["characters"] + FIRST_CHARACTER)
    least = float(min(totals[s] for s in _SIDES))
    background, target = (Model(counts, s, least / max(totals[s], 1), least, symbols) for s in _SIDES)
    return vocabulary, target, background


def losses(cells: DataFrame, target: Model, background: Model) -> DataFrame:
    """(cell, target_loss, background_loss) of distinct cells, in nats. Each order is joined at its own grain."""
    models = {"target": target, "background": background}
    if target.counts is not background.counts:
        raise ValueError("both models are sides of one table of counts")
    pair_of, last_of = (lambda c: c.bitwiseAND(F.lit(TWO))), (lambda c: c.bitwiseAND(F.lit(ONE)))
    context_of = lambda c: F.shiftright(c, BITS)

    def summed(key: Column, name: str, tag: str) -> DataFrame:
        return target.counts.groupBy(key.alias(name)).agg(*[F.sum(m.side).alias(f"{k}_{tag}") for k, m in models.items()])

    def n(side: str, tag: str) -> Column:
        return F.coalesce(F.col(f"{side}_{tag}"), F.lit(0)) * F.lit(models[side].weight)

    cell = F.col("cell")
    one = lambda k, m: (n(k, "last") + F.lit(1.0)) / F.lit(m.total + m.symbols)
    two = lambda k, m: (n(k, "pair") + F.lit(PRIOR) * one(k, m)) / (n(k, "middle") + F.lit(PRIOR))
    three = lambda k: (n(k, "cell") + F.lit(PRIOR) * F.col(f"{k}_two")) / (n(k, "context") + F.lit(PRIOR))
    pairs = (
        cells.select(pair_of(cell).alias("pair")).distinct()
        .select("pair", context_of(F.col("pair")).alias("middle"), last_of(F.col("pair")).alias("last"))
        .join(summed(pair_of(cell), "pair", "pair"), "pair", "left")
        .join(summed(last_of(context_of(cell)), "middle", "middle"), "middle", "left")
        .join(summed(last_of(cell), "last", "last"), "last", "left")
        .select("pair", *[two(k, m).alias(f"{k}_two") for k, m in models.items()])
    )
    return (
        cells.select("cell", pair_of(cell).alias("pair"), context_of(cell).alias("context"))
        .join(summed(cell, "cell", "cell"), "cell", "left")
        .join(summed(context_of(cell), "context", "context"), "context", "left")
        .join(pairs, "pair")
        .select("cell", *[(-F.log(three(k))).alias(f"{k}_loss") for k in models])
    )


def _in_blocks(docs: DataFrame) -> DataFrame:
    """(block, row): rows in blocks of about ``BLOCK`` characters; ``row`` holds all columns."""
    rows = docs.select(F.lit(0).cast("long").alias("block"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.struct("*").alias("row"))

    def task(batches):
        at, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = seen + np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
            blocks = at + ends // BLOCK
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("row")], ["block", "row"])

    schema = T.StructType([rows.schema["block"], rows.schema["row"]])
    return written(rows.mapInArrow(task, schema), "lm-blocks")


def _cells_of(blocks: DataFrame, vocabulary: list[int] | None) -> DataFrame:
    """(block, cell), distinct. The rows of a block are neighbours, so tasks hold few cells more than once."""
    def batch_of(block: int, sums: Sums) -> pa.RecordBatch:
        cells = sums.merge()[0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), block), pa.int64()), pa.array(cells, pa.int64())], ["block", "cell"])

    def task(batches):
        codes, sums, at = Codes(vocabulary), Sums(HELD), 0
        for batch in slices(batches):
            keys = batch.column(0).to_numpy()
            cells = [codes.cells(text.as_py()) for text in batch.column(1)]
            for block in dict.fromkeys(keys.tolist()):
                if block != at or sums.full():
                    yield batch_of(at, sums)
                    sums, at = Sums(HELD), block
                sums.add(np.concatenate([cells[i] for i in np.flatnonzero(keys == block)]))
        yield batch_of(at, sums)

    return blocks.select("block", F.col("row.text").alias("text")).mapInArrow(task, "block long, cell long").distinct()


def score(docs: DataFrame, vocabulary: list[int] | None, target: Model, background: Model, size: int | None = None) -> DataFrame:
    """``docs`` with tokens, mean losses and score of each row; the models know their ``size``."""
    blocks = _in_blocks(docs)
    cells = written(_cells_of(blocks, vocabulary), "lm-cells")
    table = cells.join(losses(cells.select("cell").distinct(), target, background), "cell")
    both = stack_rows(blocks.select("block", F.lit(True).alias("is_row"), "row"), table.select("block", F.lit(False).alias("is_row"), "cell", "target_loss", "background_loss"))

    def task(batches):
        codes, at, held, known = Codes(vocabulary), None, [], None
        for batch in slices(batches):
            block, is_row = batch.column("block").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                part = batch.slice(start, stop - start)
                if at != block[start]:
                    at, held, known = block[start], [], None
                if not is_row[start]:
                    held.append([part.column(c).to_numpy() for c in ("cell", "target_loss", "background_loss")])
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order, held = np.argsort(known[0]), []
                    known = [c[order] for c in known]
                yield scored(part.column("row"), codes, *known)

    def scored(rows, codes, cells, ours, theirs):
        columns = {rows.type.field(i).name: c for i, c in enumerate(rows.flatten())}
        out = []
        for text in columns["text"]:
            found = np.searchsorted(cells, codes.cells(text.as_py()))
            out.append((len(found), float(ours[found].mean()), float(theirs[found].mean())))
        n, a, b = (np.array(c) for c in zip(*out, strict=True))
        kept = {x: c for x, c in columns.items() if x not in _ADDED}
        added = (n, pa.int64()), (a, pa.float64()), (b, pa.float64()), (a - b, pa.float64())
        return pa.RecordBatch.from_pydict(kept | {x: pa.array(v, k) for x, (v, k) in zip(_ADDED, added, strict=True)})

    kinds = [T.LongType(), *[T.DoubleType()] * 3]
    fields = [f for f in docs.schema.fields if f.name not in _ADDED] + [T.StructField(n, k) for n, k in zip(_ADDED, kinds, strict=True)]
    return both.repartition("block").sortWithinPartitions("block", "is_row").mapInArrow(task, T.StructType(fields))
