"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts (null and empty texts are one group); a group is never split. Packing is
in two levels, so that no task and no driver holds all groups:

1. Groups are dealt to cells by digest. In a cell, groups sorted by size enter the tightest *crate* that
   still has room, found in a balanced tree over the remaining capacities; a group larger than a crate
   is a crate of its own. A crate holds ``1 / CRATES`` of a shard.
2. Crates, at most about twice ``shards * CRATES`` plus one for each cell, are packed likewise into
   ``shards`` bins of the smallest capacity that holds them all.

The law is ``bytes``: shards differ by about a crate unless one group alone exceeds a shard. Slots number
the rows of a shard without gaps: crates in a shard, groups in a crate and rows in a group follow one
another. Rows of a large group are numbered in pieces of about ``PIECE_ROWS``.

A null text has no bytes, so its row weighs ``ROW_BYTES``. Rows that repeat id and text get slots of their
own; null ids come first in their group. Other columns are not read. No rows: no shards.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.tables import text_of
from corpusflow.session import written

ROW_BYTES = 8
CRATES = 256
#: Groups that a cell holds, on average.
CELL_GROUPS = 100_000
PIECE_ROWS = 50_000
#: How much more capacity each further trial of the second level gets.
STEP = 1.0005


class Rooms:
    """Bins by remaining capacity in a balanced tree of two levels: leaves of up to ``2 * WIDTH`` sorted bins, split in
    halves when they are full, under one node of their maxima. Finding the tightest bin is two bisections."""

    WIDTH = 512

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []

    def put(self, room: int, name: int) -> None:
        at = min(bisect.bisect_left(self.tops, (room, name)), len(self.blocks) - 1)
        block = self.blocks[at]
        bisect.insort(block, (room, name))
        if len(block) > 2 * self.WIDTH:
            self.blocks[at : at + 1] = [block[: self.WIDTH], block[self.WIDTH :]]
            self.tops[at : at + 1] = [block[self.WIDTH - 1], block[-1]]
        else:
            self.tops[at : at + 1] = [block[-1]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is not below ``size``."""
        at = bisect.bisect_left(self.tops, (size, -1))
        if at == len(self.tops):
            return None
        block = self.blocks[at]
        found = block.pop(bisect.bisect_left(block, (size, -1)))
        if block:
            self.tops[at] = block[-1]
        elif len(self.blocks) > 1:
            del self.blocks[at], self.tops[at]
        else:
            self.tops = []
        return found


def best_fit(sizes: np.ndarray, capacity: int, bins: int | None = None) -> np.ndarray | None:
    """The bin of each item, items taken by decreasing size (ties: earlier first); an item above the capacity
    has a bin to itself. None if more than ``bins`` bins are needed."""
    out, rooms, opened = np.empty(len(sizes), np.int64), Rooms(), 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = rooms.take(size) if size <= capacity else None
        if found is None:
            if bins is not None and opened == bins:
                return None
            found, opened = (capacity, opened), opened + 1
        out[item] = found[1]
        if found[0] > size:
            rooms.put(found[0] - size, found[1])
    return out


def fewest_bytes(sizes: np.ndarray, bins: int) -> np.ndarray:
    """``best_fit`` into ``bins`` bins at the smallest of the capacities tried, from the mean upwards.

    An item above the mean of what is left fills a bin alone and counts no more for the mean.
    """
    rest, left = int(sizes.sum()), bins
    for size in np.sort(sizes)[::-1].tolist():
        if left == 1 or size * left <= rest:
            break
        rest, left = rest - size, left - 1
    capacity = max(1, -(-rest // left))
    while (found := best_fit(sizes, capacity, bins)) is None:
        capacity = max(capacity + 1, int(capacity * STEP))
    return found


def _pack_cell(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("digest", ignore_index=True)
        crate = best_fit(frame["group_bytes"].to_numpy(), capacity)
        rows = frame["group_rows"].to_numpy()
        order = np.argsort(crate, kind="stable")
        before = np.cumsum(rows[order]) - rows[order]
        first = np.r_[True, np.diff(crate[order]) > 0]
        offset = np.empty(len(frame), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(frame)]))
        return frame[["cell", "digest", "group_rows", "group_bytes"]].assign(crate=crate, crate_offset=offset)

    return pack


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``: near equal shares of the bytes."""
    return _packed(docs, shards, None)


def shard_by_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """The same with shards of a fixed capacity in bytes, as few as best fit needs; a larger group has a shard alone."""
    return _packed(docs, None, capacity)


def _packed(docs: DataFrame, shards: int | None, shard_bytes: int | None) -> DataFrame:
    spark = docs.sparkSession
    rows = written(_rows(docs), "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_rows"), F.sum("size").alias("group_bytes")), "shard-groups")
    n_groups, total = groups.agg(F.count(F.lit(1)), F.sum("group_bytes")).first()
    cells = max(1, -(-n_groups // CELL_GROUPS))
    capacity = max(1, -(-(total or 0) // (shards * CRATES)) if shards else shard_bytes // CRATES)
    celled = groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int"))
    packed = written(
        celled.groupBy("cell").applyInPandas(
            _pack_cell(capacity), "cell int, digest binary, group_rows long, group_bytes long, crate long, crate_offset long"
        ),
        "shard-cells",
    )
    crates = packed.groupBy("cell", "crate").agg(F.sum("group_rows").alias("rows"), F.sum("group_bytes").alias("bytes")).toPandas()
    crates = crates.sort_values(["cell", "crate"], ignore_index=True)
    sizes = crates["bytes"].to_numpy(np.int64)
    crates["shard"] = (fewest_bytes(sizes, shards) if shards else best_fit(sizes, shard_bytes)).astype(np.int32)
    crates["shard_offset"] = crates.groupby("shard")["rows"].cumsum() - crates["rows"]
    placed = spark.createDataFrame(crates[["cell", "crate", "shard", "shard_offset"]], "cell int, crate long, shard int, shard_offset long")
    starts = packed.join(placed, ["cell", "crate"]).select("digest", "group_rows", "shard", (F.col("shard_offset") + F.col("crate_offset")).alias("start"))

    pieces = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_rows") / PIECE_ROWS)).cast("long")
    spread = rows.join(starts, "digest").withColumn("piece", pieces)
    sizes = spread.filter(F.col("group_rows") > PIECE_ROWS).groupBy("digest", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("digest").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("digest", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("piece_offset"))
    inside = F.row_number().over(Window.partitionBy("digest", "piece").orderBy("doc_id")) - 1
    return spread.withColumn("inside", inside).join(offsets, ["digest", "piece"], "left").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.coalesce("piece_offset", F.lit(0)) + F.col("inside")).cast("long").alias("slot")
    )
