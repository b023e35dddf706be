"""Token ids of documents in fixed-length rows, by best-fit-decreasing packing.

Each document is encoded (byte-level BPE ranks of a public vocabulary) and closed by an end token, so that an
empty or null text is one token. A document above ``length`` tokens is cut into pieces of ``length`` and a
rest; no token is lost. Pieces wait in a buffer of ``BUFFER_TOKENS``; when it is full they are taken by
decreasing size, and each enters the row with the least room that holds it, found in a segment tree over the
possible rooms. Each task packs what it reads: nothing is shuffled and memory is bounded by the buffer, at
the price of one partly filled row or so for each buffer.

A row holds ``length`` ids as little-endian unsigned 16-bit or 32-bit integers (as the vocabulary needs),
padded with the end token; ``cu_seqlens``, the cumulative lengths of its segments; ``doc_ids`` and ``pieces``,
what the segments are; and ``resets``, the place of each segment's first token in its document, where
positions begin anew at 0. ``unpack`` gives the documents back.

The library's pattern fails on white space of a million characters in a row, so long runs are cut out before it sees
the text: all of a run but its last character is always one piece of the pattern (all of it at the end of a text), and that piece
is encoded as a whole. Ids are those of the pattern at any length.

Null ids and repeated rows are documents like others, told apart by ``row_no`` inside a task. Columns besides
id and text are not written.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.tables import slices

LENGTH = 2048
BUFFER_TOKENS = 4_000_000
ROW_SCHEMA = (
    "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, "
    "n_pieces array<int>, row_nos array<long>, resets array<int>"
)


@functools.lru_cache(maxsize=4)
def byte_vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space runs from this length are encoded apart. The characters are those that the library's ``\\s`` knows.
LONG_RUN = 4096
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@functools.lru_cache(maxsize=4)
def _one_piece(path: str) -> tiktoken.Encoding:
    """The vocabulary with a pattern that takes any text as one piece."""
    return byte_vocabulary(path, r"(?s:.)+")


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text of any shape."""
    encoding, ids, at = byte_vocabulary(path, pattern), [], 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += _one_piece(path).encode_ordinary(text[run.start() : stop])
        at = stop
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


class RoomTree:
    """How many rows have each amount of room: a segment tree over 0..length, descended to the least room that fits."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room that is at least ``need``."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """The items of each row; items by decreasing size, ties in the order given."""
    tree, rows = RoomTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(item)
        if found[0] > sizes[item]:
            tree.put(found[0] - sizes[item], found[1])
    return rows


class _Packer:
    def __init__(self, length: int, end_id: int) -> None:
        self.length, self.end_id = length, end_id
        self.dtype = np.dtype("<u2" if end_id < 1 << 16 else "<u4")
        self.task = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.made = self.seen = self.tokens = 0
        self.waiting: list[tuple] = []

    def add(self, doc_id: int | None, ids: list[int]) -> None:
        held = np.array([*ids, self.end_id], self.dtype)
        n = -(-len(held) // self.length)
        for piece in range(n):
            part = held[piece * self.length : (piece + 1) * self.length]
            self.waiting.append((part, doc_id, piece, n, self.seen))
        self.tokens += len(held)
        self.seen += 1

    def rows(self) -> pa.RecordBatch:
        out: dict[str, list] = {name.split()[0]: [] for name in ROW_SCHEMA.split(", ")}
        for items in best_fit([len(w[0]) for w in self.waiting], self.length):
            parts = [self.waiting[i] for i in items]
            ids = np.full(self.length, self.end_id, self.dtype)
            ends = np.cumsum([len(p[0]) for p in parts]).tolist()
            ids[: ends[-1]] = np.concatenate([p[0] for p in parts])
            out["pack_id"].append((self.task << 40) + self.made)
            out["ids"].append(ids.tobytes())
            out["n_tokens"].append(ends[-1])
            out["cu_seqlens"].append([0, *ends])
            for name, k in (("doc_ids", 1), ("pieces", 2), ("n_pieces", 3)):
                out[name].append([p[k] for p in parts])
            out["row_nos"].append([(self.task << 40) + p[4] for p in parts])
            out["resets"].append([p[2] * self.length for p in parts])
            self.made += 1
        self.waiting, self.tokens = [], 0
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array(out[n], kinds[k]) for n, k in (f.split() for f in ROW_SCHEMA.split(", "))], list(out))


def pack(docs: DataFrame, path: str, pattern: str, end_id: int, length: int = LENGTH, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """The packed rows of all documents."""
    def task(batches):
        packer = _Packer(length, end_id)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encode_text(text.as_py() or "", path, pattern))
                if packer.tokens >= buffer_tokens:
                    yield packer.rows()
        if packer.waiting:
            yield packer.rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, ROW_SCHEMA)


def segments(packed: DataFrame) -> DataFrame:
    """One row for each segment: the document, its piece, and the bytes of its ids."""
    return packed.select(
        "pack_id", "ids", F.posexplode(F.arrays_zip("doc_ids", "pieces", "n_pieces", "row_nos")).alias("at", "s"), "cu_seqlens"
    ).select("pack_id", "at", "s.*", F.col("cu_seqlens")[F.col("at")].alias("start"), F.col("cu_seqlens")[F.col("at") + 1].alias("stop"), "ids")


def unpack(packed: DataFrame, id_bytes: int) -> DataFrame:
    """(doc_id, row_no, ids) for each document: its segments, put together again."""
    rows = segments(packed).select(
        "row_nos", "doc_ids", "pieces", F.expr(f"substring(ids, start * {id_bytes} + 1, (stop - start) * {id_bytes})").alias("part")
    )
    return rows.groupBy("row_nos").agg(
        F.first("doc_ids").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pieces", "part"))).alias("parts")
    ).select("doc_id", F.col("row_nos").alias("row_no"), F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"])).alias("ids"))
