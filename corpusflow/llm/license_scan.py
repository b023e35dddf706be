"""Licences in documents: MinHash bands over overlapping windows find templates, exact shingle containment decides.

Retrieval. Windows of ``WINDOW`` shingles begin at every ``STRIDE``-th word of a text; templates have one at every word, so each
window that lies in a copy has its counterpart. A window's minima under ``BANDS`` permutations of its shingle hashes are its bands, of
one row each, and equal bands make (text, template) a candidate. Two windows of Jaccard similarity s miss each other with chance
(1 - s)^8. Where a fifth of the shingles of a copy was changed, windows have s of 2/3 on average: a miss has chance 1.5e-4 with
one window and below 1e-7 from two on; a copy of 100 words has five or more. Templates under ``WINDOW + STRIDE`` shingles might have
no whole window in a copy, so for them a window is one shingle: its minimum is its hash, and no copy that holds a shingle can miss.

Verification. A template of L words is looked for in windows of L + s words that begin at each multiple of s = max(1, L / 4),
so that each run of L words lies whole in a window. Shingles of candidate texts are joined with those of their templates by hash,
compared as strings, and counted in the windows that they lie in. A window holds a template if it has the share ``CONTAINED`` of
the template's distinct shingles.

``scan`` reports each template held. ``identify`` looks for ``TEMPLATES``, the notices, whole texts and standard
headers. It asks of a window each telling phrase of its template (name and version where texts share their
opening), and of windows that share a shingle of the document it keeps the licence with most shingles held.

Only DataFrame functions run. The tables of shingles and bands are fixed by the templates and are broadcast. Candidates are counted:
up to ``BROADCAST_ROWS`` texts are broadcast to the documents, more are joined by a shuffle on the hash of the text.

Words are read with A-Z in lower case. Null, empty and wordless texts hold no template. Rows with equal ids and
texts are one; equal ids with other texts are told apart. Null ids are ids like others. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import license_texts
from corpusflow.llm.native_words import gram_hashes, let, words
from corpusflow.llm.tables import text_of
from corpusflow.session import written

SHINGLE = 5
CONTAINED = 0.8
#: Shingles of a window, words from one window to the next, and minima that are compared.
WINDOW, STRIDE, BANDS = 28, 16, 8
BROADCAST_ROWS = 200_000
#: Shingles of a document that travel with their words in one row until they are joined.
PIECE = 16

#: Notices by which works name their licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Phrases that a text must have to be one of the notices, by position.
TELLING = {
    0: ("apache license version 2 0",),
    1: ("apache license version 2 0",),
    2: ("gnu general public license", "version 3"),
    3: ("gnu general public license",),
    7: ("mozilla public license v 2",),
    8: ("commons attribution 4 0",),
    9: ("cc by nc 4 0",),
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


_NOTICED = [template_words(text) for _, text in NOTICES]
#: What ``identify`` looks for; the notices keep their numbers and are not repeated.
TEMPLATES = (
    *((*n, TELLING.get(i, ())) for i, n in enumerate(NOTICES)),
    *(x for x in license_texts.texts() if template_words(x[1]) not in _NOTICED),
)


def _hashed(w: Column) -> Column:
    """Hashes of the shingles of a word array."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: gram_hashes(h, F.size(h), SHINGLE))


def template_table(spark: SparkSession, notices) -> DataFrame:
    """(hash, shingle, template, license, n_words, n_shingles, tells, wanted): the distinct shingles of each template.

    ``tells`` has a bit for each telling phrase that the shingle holds, ``wanted`` the bits of all phrases.
    """
    rows = []
    for i, (name, text, *telling) in enumerate(notices):
        w, phrases = template_words(text), [f" {' '.join(template_words(x))} " for x in (telling[0] if telling else ())]
        if len(w) < SHINGLE:
            raise ValueError(f"a template has at least {SHINGLE} words")
        shingles = dict.fromkeys(" ".join(w[j : j + SHINGLE]) for j in range(len(w) - SHINGLE + 1))
        if any(all(x not in f" {g} " for g in shingles) for x in phrases):
            raise ValueError("a shingle of its template holds each telling phrase")
        held = [(g, sum(1 << b for b, x in enumerate(phrases) if x in f" {g} ")) for g in shingles]
        rows.append((i, name, len(w), len(held), (1 << len(phrases)) - 1, held))
    df = spark.createDataFrame(rows, "template int, license string, n_words int, n_shingles int, wanted long, held array<struct<shingle: string, tells: long>>")
    df = df.select("template", "license", "n_words", "n_shingles", "wanted", F.inline("held"))
    return df.withColumn("hash", let(F.split("shingle", " "), _hashed)[0])


def _pieces(w: Column) -> Column:
    """A word array in pieces of ``PIECE`` shingles: (at, part)."""
    starts = F.sequence(F.lit(0), F.floor((F.size(w) - SHINGLE) / PIECE).cast("int"))
    piece = lambda i: F.struct((i * PIECE).alias("at"), F.slice(w, i * PIECE + 1, PIECE + SHINGLE - 1).alias("part"))
    return F.when(F.size(w) >= SHINGLE, F.transform(starts, piece))


def _bands(hashes: Column, stride: int) -> Column:
    """The bands of all windows of an array of shingle hashes: the minimum under each permutation, marked with its number."""
    seeds = [int.from_bytes(hashlib.sha256(b"band %d" % k).digest()[:8], "big", signed=True) for k in range(BANDS)]
    least = lambda h, k: F.xxhash64(F.array_min(F.transform(h, lambda x: x.bitwiseXOR(F.lit(seeds[k])))), F.lit(k))
    window = lambda i: let(F.slice(hashes, i * stride + 1, WINDOW), lambda h: F.array(*[least(h, k) for k in range(BANDS)]))
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - WINDOW) / stride).cast("int"))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) >= WINDOW, F.flatten(F.transform(starts, window))).otherwise(none)


def _keys(spark: SparkSession, notices) -> tuple[DataFrame, list[int]]:
    """(key, template): the bands of long templates and the shingles of short ones; and the hashes of the latter."""
    rows = [(i, template_words(text)) for i, (_, text, *_) in enumerate(notices)]
    hashed = spark.createDataFrame(rows, "template int, w array<string>").select("template", _hashed(F.col("w")).alias("h"))
    short = F.size("h") < WINDOW + STRIDE
    keys = hashed.select("template", short.alias("short"), F.explode(F.when(short, F.col("h")).otherwise(_bands(F.col("h"), 1))).alias("key")).distinct()
    keys = written(keys, "template-keys")
    held = [r["key"] for r in keys.filter("short").select("key").distinct().collect()]  # as many as short templates have words
    return keys.select("key", "template"), held


def candidates(docs: DataFrame, notices) -> DataFrame:
    """(text_key, may): the templates that the bands of a text, or its single shingles, point to."""
    keys, short = _keys(docs.sparkSession, notices)
    both = lambda h: F.concat(_bands(h, STRIDE), F.filter(h, lambda x: x.isin(short)) if short else F.array().cast("array<bigint>"))
    w = lambda w: F.when(F.size(w) >= SHINGLE, let(_hashed(w), both))
    found = docs.select(F.xxhash64(text_of("text")).alias("text_key"), F.explode_outer(F.array_distinct(let(words("text"), w))).alias("key"))
    pairs = found.join(F.broadcast(keys), "key")
    return pairs.groupBy("text_key").agg(F.collect_set("template").alias("may"))


def _held(docs: DataFrame, notices) -> DataFrame:
    """(doc_id, text_key, template, license, start, n_held, containment, told, at): the windows that hold a template, and
    the places of its shingles in the document."""
    known = written(candidates(docs, notices), "candidates")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    texts = docs.select("doc_id", F.xxhash64(text_of("text")).alias("text_key"), "text").join(known, "text_key")
    keyed = texts.select("doc_id", "text_key", "may", let(words("text"), _pieces).alias("pieces"))
    # Outer: of an inner one the planner would ask beforehand, of every document, whether it gives any row.
    pieces = keyed.select("doc_id", "text_key", "may", F.inline_outer("pieces"))
    grams = pieces.select("doc_id", "text_key", "may", "at", "part", F.posexplode(_hashed(F.col("part"))).alias("j", "hash"))
    same = F.concat_ws(" ", F.slice("part", F.col("j") + 1, SHINGLE)) == F.col("shingle")
    hits = grams.join(F.broadcast(template_table(docs.sparkSession, notices)), "hash").filter(same & F.array_contains("may", F.col("template"))).withColumn("p", F.col("at") + F.col("j"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n_words") / 4).cast("int"))
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - (F.col("n_words") + stride - SHINGLE)) / stride).cast("int"))
    steps = F.sequence(first, F.floor(F.col("p") / stride).cast("int"))
    starts = F.transform(steps, lambda k: k * stride)
    found = hits.select("doc_id", "text_key", "template", "license", "n_shingles", "wanted", "tells", "shingle", "p", F.explode(starts).alias("start"))
    counted = found.groupBy("doc_id", "text_key", "template", "license", "n_shingles", "wanted", "start").agg(
        F.size(F.collect_set("shingle")).alias("n_held"), F.bit_or("tells").alias("told"), F.collect_set("p").alias("at")
    )
    share = F.col("n_held") / F.col("n_shingles")
    return counted.select(
        "doc_id", "text_key", "template", "license", "start", "n_held", share.alias("containment"), (F.col("told") == F.col("wanted")).alias("told"), "at"
    ).filter(F.col("containment") >= CONTAINED)


def _reported(windows: DataFrame) -> DataFrame:
    return windows.groupBy("doc_id", "text_key", "template", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("start"))


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """(doc_id, text_key, template, license, containment, start): each template that a document holds, with the
    largest containment in a window and the first word of the first window that verifies."""
    return _reported(_held(docs, notices))


def identify(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """As ``scan``, of occurrences with all telling phrases, and of licences that lay claim to the same words the best only.

    A window without the phrases counts where it shares a shingle with a window of the template that has them.
    """
    rank = F.when(F.col("told"), F.struct("n_held", "containment", (-F.col("template")).alias("order"), "license"))
    claims = _held(docs, templates).withColumn("rank", rank).withColumn("p", F.explode("at"))
    place = ["doc_id", "text_key", "p"]
    best = F.max("rank").over(Window.partitionBy(*place))["license"]
    told = F.max("told").over(Window.partitionBy(*place, "template"))
    judged = claims.select("doc_id", "text_key", "template", "license", "start", "containment", told.alias("told"), (best != F.col("license")).alias("lost"))
    windows = judged.groupBy("doc_id", "text_key", "template", "license", "start", "containment").agg(F.max("told").alias("told"), F.max("lost").alias("lost"))
    return _reported(windows.filter("told AND NOT lost"))
