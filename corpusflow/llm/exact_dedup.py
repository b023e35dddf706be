"""Exact deduplication against an archive of digests held in minimal perfect hashes.

The archive keeps the distinct digests of what was ingested before, in shards of about ``SHARD_KEYS``
digests. A shard is a minimal perfect hash (levels of bit arrays: a key takes the first level where it
collides with no other) and two slot arrays: the full digest and the locator of its winner. A look-up
finds the one slot that a digest can have and compares all of its bytes; digests that differ are not in
the archive and are grouped among themselves.

Equal texts meet as counts: rows are summed by digest before they are shuffled, and the rows of a hot
digest are joined to their group by a join that adaptive execution may split.

Null texts count as empty. Among equal texts the archive's winner stays, else the smallest ``doc_id``;
a null ``doc_id`` comes after all others. A winning row that is repeated in full stays once in
``deduplicate`` and carries ``kept`` on each of its rows in ``group_rows``. Columns besides the id and
the text pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.tables import keep_rows, row_id, text_of
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written

DIGEST_BYTES = 32
#: Digests in a shard of the archive, on average: about 4 MB in a task.
SHARD_KEYS = 65_536
#: Bits in a level of the hash for each key that is left.
LOAD = 2
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

INDEX_SCHEMA = "shard int, n_keys long, level_bits array<long>, bits binary, slot_digests binary, slot_keepers binary, slot_known binary"


def normalized(text: Column | str) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view(np.uint64)
    return words[:, 0] ^ words[:, 2], words[:, 1] ^ words[:, 3]


def _positions(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    x = low + np.uint64((level + 1) * _MIX[0] & 0xFFFFFFFFFFFFFFFF) * (high | np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct digests (rows of 32 bytes)."""
    low, high = _halves(digests)
    sizes, levels = [], []
    while len(low):
        size = max(64, LOAD * len(low))
        at = _positions(low, high, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        rest = ~alone[at]
        low, high = low[rest], high[rest]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; of a digest that was not in the build, some slot or -1."""
    low, high = _halves(digests)
    rank = np.cumsum(bits) - 1
    found, open_, start = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = start + _positions(low[open_], high[open_], level, size)
        hit = bits[at]
        found[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        start += size
    return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, DIGEST_BYTES).copy()


def _shard_index(frame: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(frame["digest"])
    sizes, bits = build_hash(digests)
    at = slots_of(digests, sizes, bits)
    held, keepers, known = np.empty_like(digests), np.zeros(len(frame), np.int64), np.zeros(len(frame), np.uint8)
    held[at] = digests
    keepers[at] = frame["keep_id"].fillna(0).to_numpy(np.int64)
    known[at] = frame["keep_id"].notna()
    return pd.DataFrame({
        "shard": [int(frame["shard"].iloc[0])], "n_keys": [len(frame)], "level_bits": [sizes],
        "bits": [np.packbits(bits).tobytes()], "slot_digests": [held.tobytes()],
        "slot_keepers": [keepers.tobytes()], "slot_known": [known.tobytes()],
    })


def _look_up(index: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"digest": frame["digest"], "archived": False, "archive_keep_id": pd.array([None] * len(frame), "Int64")})
    if len(index) and len(frame):
        row = index.iloc[0]
        sizes = [int(x) for x in row["level_bits"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        asked, held = _matrix(frame["digest"]), np.frombuffer(row["slot_digests"], np.uint8).reshape(-1, DIGEST_BYTES)
        at = slots_of(asked, sizes, bits)
        member = (at >= 0) & (held[at] == asked).all(axis=1)
        keepers = pd.array(np.frombuffer(row["slot_keepers"], np.int64)[at], "Int64")
        keepers[~(member & np.frombuffer(row["slot_known"], np.uint8)[at].astype(bool))] = pd.NA
        out["archived"], out["archive_keep_id"] = member, keepers
    return out


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, n_rows): the smallest id and the number of rows of each digest."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def _with_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def shard_count(*tables: DataFrame) -> int:
    """Shards for tables of distinct digests; reads their row counts."""
    return max(1, -(-max(t.count() for t in tables) // SHARD_KEYS))


def build_archive(digests: DataFrame, shards: int) -> DataFrame:
    """The archive over (digest, keep_id), one row for each shard."""
    return _with_shard(digests.select("digest", "keep_id"), shards).groupBy("shard").applyInPandas(_shard_index, INDEX_SCHEMA)


def look_up(archive: DataFrame, digests: DataFrame, shards: int) -> DataFrame:
    """(digest, archived, archive_keep_id) for each distinct digest asked."""
    asked = _with_shard(digests.select("digest"), shards).groupBy("shard")
    return archive.groupBy("shard").cogroup(asked).applyInPandas(_look_up, "digest binary, archived boolean, archive_keep_id long")


def groups_of(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) for each digest in either table of (doc_id, digest)."""
    archived, fresh = written(distinct_digests(history), "archive-digests"), written(distinct_digests(incoming), "incoming-digests")
    shards = shard_count(archived, fresh)
    archive = written(build_archive(archived, shards), "archive")
    repeats = written(look_up(archive, fresh, shards), "lookups")
    added = fresh.join(repeats, "digest").select(
        "digest", F.when(F.col("archived"), F.col("archive_keep_id")).otherwise(F.col("keep_id")).alias("keep_id"), "keep_id", "n_rows", "archived"
    ).toDF("digest", "keep_id", "own_id", "n_rows", "archived")
    old = archived.join(added.filter("archived").select("digest", F.col("own_id"), F.col("n_rows").alias("more")), "digest", "left").select(
        "digest", F.coalesce("keep_id", "own_id").alias("keep_id"), (F.col("n_rows") + F.coalesce("more", F.lit(0))).alias("group_size")
    )
    new = added.filter(~F.col("archived")).select("digest", "keep_id", F.col("n_rows").alias("group_size"))
    return written(stack_rows(old, new), "groups")


def group_rows(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of both tables of (doc_id, digest)."""
    groups = groups_of(history, incoming)
    rows = stack_rows(history.select("doc_id", "digest"), incoming.select("doc_id", "digest"))
    return rows.join(groups, "digest").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))


def by_age(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as an older and a newer part: the lower and the upper half of the id range; no id is newer."""
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("middle")).first()["middle"]
    older = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return docs.filter(older), docs.filter(~older)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each normalised text.

    Rows that tie for a text (same id, or no id at all) are settled by the hash of the whole row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest("text").alias("digest"))
    winners = groups_of(*by_age(rows)).select(row_id("keep_id").alias("k0"), F.col("digest").alias("k1"))
    # By id and digest, so that the rows of a hot digest lie apart.
    counted = rows.groupBy(row_id().alias("k0"), F.col("digest").alias("k1")).agg((F.count(F.lit(1)) > 1).alias("once"))
    return keep_rows(docs, [row_id(), text_digest("text")], written(counted.join(winners, ["k0", "k1"]), "keepers"))
