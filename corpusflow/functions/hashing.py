"""Hashes that any SQL engine with md5 can repeat, for sampling and shuffles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def _key(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def digest(*parts) -> Column:
    """md5 of the parts joined with ``|``; the sort key of a reproducible permutation."""
    return F.md5(_key(parts))


def bucket_hash(*parts) -> Column:
    """The first 32 bits of :func:`digest` as a bigint in [0, 2**32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def keep_fraction(fraction: float, *parts) -> Column:
    """True for about ``fraction`` of all keys, the same ones on every run."""
    return bucket_hash(*parts) < F.lit(int(round(fraction * HASH_RANGE)))
