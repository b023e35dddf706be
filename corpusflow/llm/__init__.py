"""Operators of a training-data pipeline: deduplication, scoring, scanning, tokens, archives and shards."""
