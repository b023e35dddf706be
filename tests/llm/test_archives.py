import glob
import gzip
import hashlib
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge_cases import LONG, ROWS, documents, prose  # noqa: E402

from corpusflow.llm import sequence_packing, shard_packing, warc_store  # noqa: E402

HTML = "<html>" + prose(40) + "</html>"
PAGES = [
    (3, "http://a/3", HTML, "x"),
    (2, "http://a/2", HTML, "x"),
    (7, "http://a/7\r\nWARC-Type: odd", HTML, None),
    (2, "http://a/2", HTML, "x"),
    (4, None, "short", "x"),
    (5, "http://a/5", "short", "x"),
    (6, "http://a/6", None, "x"),
    (8, "http://a/8", "", "x"),
    (9, "http://a/9", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (None, "http://a/none", HTML, "x"),
    (None, "http://a/none", "only here " * 20, "x"),
]
KEY = lambda r: tuple(map(repr, r))


def pages(spark, rows=None):
    return spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string, digest string")


def expected():
    ids = {}
    for page, _, html, _ in PAGES:
        ids.setdefault(html or "", []).append(page)
    first = {h: min((i for i in v if i is not None), default=None) for h, v in ids.items()}
    out = []
    for page, _, html, _ in PAGES:
        raw = (html or "").encode()
        later = len(raw) >= 100 and first[html or ""] is not None and page != first[html or ""]
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", first[html] if later else None))
    return out


def test_archive_reads_back_what_was_written(spark, tmp_path):
    warc_store.archive(pages(spark), f"{tmp_path}/w")
    found = warc_store.described(spark, f"{tmp_path}/w")
    assert sorted(map(tuple, found.collect()), key=KEY) == sorted(expected(), key=KEY)
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/w/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h, _ in PAGES})


def test_warc_files_hold_the_exact_records(spark, tmp_path):
    warc_store.archive(pages(spark), f"{tmp_path}/w")
    warc_store.export_warc(spark, f"{tmp_path}/w", f"{tmp_path}/files")
    read = sorted((bytes(r.header), bytes(r.payload)) for r in warc_store.import_warc(spark, f"{tmp_path}/files").collect())
    whole = [(bytes(r.header), bytes(r.payload)) for r in warc_store.reconstruct(spark, f"{tmp_path}/w").collect()]
    assert read == sorted((h, b"" if b"WARC-Type: revisit\r\n" in h else p) for h, p in whole)
    assert all(h.startswith(b"WARC/1.1\r\n") and h.endswith(b"\r\n\r\n") and h.count(b"\r\nWARC-Type: ") == 1 for h, _ in read)


def test_archive_read_back_from_its_files_alone(spark, tmp_path):
    warc_store.archive(pages(spark), f"{tmp_path}/w")
    warc_store.export_warc(spark, f"{tmp_path}/w", f"{tmp_path}/files")
    found = warc_store.described_files(spark, f"{tmp_path}/files")
    assert sorted(map(tuple, found.collect()), key=KEY) == sorted(expected(), key=KEY)
    files = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/files/*.gz"))
    assert files.count(HTML.encode()) == sum(h == HTML and i == 2 for i, _, h, _ in PAGES)


def test_large_payloads_and_records_inside_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_store, "FILE_BYTES", 1 << 20)
    record = "WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    large = "".join(chr(97 + i % 26) for i in range(1 << 20)) * 40
    rows = [(1, "u", record * 5, ""), (2, "u", record * 5, ""), (3, "u", large, ""), (4, "u", large, ""), (5, "u", "\r\n\r\n" * 40, "")]
    rows += [(100 + i, "u", "" if i % 3 else f"{i} " * 400, "") for i in range(60)]
    warc_store.archive(pages(spark, rows), f"{tmp_path}/w")
    warc_store.export_warc(spark, f"{tmp_path}/w", f"{tmp_path}/files")
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.described_files(spark, f"{tmp_path}/files").collect()}
    first = {}
    for page, _, html, _ in rows:
        first.setdefault(html, page)
    want = {}
    for page, _, html, _ in rows:
        later = len(html) >= 100 and first[html] != page
        want[page] = (len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit" if later else "response", first[html] if later else None)
    assert found == want and len(glob.glob(f"{tmp_path}/files/*.gz")) > 3
    plan = warc_store._with_payload(spark, f"{tmp_path}/w", spark.read.parquet(f"{tmp_path}/w/headers").select("header", "digest"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the headers; payloads stay where they are


def test_a_revisit_without_its_response_fails_the_job(spark, tmp_path):
    warc_store.archive(pages(spark), f"{tmp_path}/w")
    headers = spark.read.parquet(f"{tmp_path}/w/headers").filter("record_type = 'revisit'")
    headers.select(F.col("header").cast("string")).write.option("lineSep", "\r\n\r\n").text(f"{tmp_path}/files")
    with pytest.raises(Exception, match="in no response"):
        warc_store.described_files(spark, f"{tmp_path}/files").collect()


def test_empty_archive(spark, tmp_path):
    warc_store.archive(pages(spark, []), f"{tmp_path}/w")
    assert warc_store.described(spark, f"{tmp_path}/w").count() == 0
    warc_store.export_warc(spark, f"{tmp_path}/w", f"{tmp_path}/files")
    assert warc_store.described_files(spark, f"{tmp_path}/files").count() == 0


@pytest.mark.parametrize("capacity", [5, 40, 1000])
def test_rooms_are_the_tightest(capacity):
    draw = random.Random(capacity)
    sizes = np.array([draw.randint(1, 30) for _ in range(3000)])
    rooms, bins = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]] if sizes[i] <= capacity else []
        if fits:
            rooms.remove(min(fits))
        bins.append(not fits)
        rest = (min(fits) if fits else capacity) - sizes[i]
        if rest > 0:
            rooms.append(rest)
    found = shard_packing.best_fit(sizes, capacity)
    assert found.max() + 1 == sum(bins)
    held = np.bincount(found, weights=sizes)
    assert all(h <= capacity or (found == b).sum() == 1 for b, h in enumerate(held))


@pytest.mark.parametrize(("cells", "piece"), [(100_000, 50_000), (3, 2)])
def test_shards_are_even_whole_and_gapless(spark, monkeypatch, cells, piece):
    monkeypatch.setattr(shard_packing, "CELL_GROUPS", cells)
    monkeypatch.setattr(shard_packing, "PIECE_ROWS", piece)
    draw = random.Random(8)
    rows = ROWS + [(400 + i, prose(draw.randint(1, 60), draw), "", 0, "") for i in range(300)] + [(800 + i, "one text of a group", "", 0, "") for i in range(40)]
    found = shard_packing.shard_by_bytes(documents(spark, rows), 4).toPandas()
    assert sorted(map(repr, zip(found["doc_id"].astype("Int64").tolist(), found["size"].tolist(), strict=True))) == sorted(
        repr((i if i is not None else __import__("pandas").NA, len((t or "").encode()) + 8)) for i, t, *_ in rows
    )
    for _, shard in found.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    texts = {}
    for r in found.itertuples():
        texts.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    held = found.groupby("shard")["size"].sum().sort_values()
    assert len(held) == 4 and held.iloc[2] - held.iloc[0] <= 0.02 * held.iloc[:3].mean()
    assert shard_packing.shard_by_bytes(documents(spark, []), 4).count() == 0


def test_shards_of_a_fixed_capacity(spark):
    draw = random.Random(8)
    rows = [(i, prose(draw.randint(1, 60), draw), "", 0, "") for i in range(300)] + [(999, LONG, "", 0, "")]
    found = shard_packing.shard_by_capacity(documents(spark, rows), 5000).toPandas()
    held = found.groupby("shard")["size"].sum()
    alone = found.groupby("shard").size()
    assert ((held <= 5000) | (alone == 1)).all() and len(held) <= -(-(held.sum() - held.max()) // 5000) + 2
    assert all(sorted(s["slot"]) == list(range(len(s))) for _, s in found.groupby("shard"))


@pytest.mark.parametrize("buffer", [10**6, 50])
def test_packed_rows_give_every_document_back(spark, buffer):
    path, pattern, length = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 32
    packed = sequence_packing.pack(documents(spark), path, pattern, 50_256, length, buffer).collect()
    encoding = sequence_packing.byte_vocabulary(path, pattern)
    want = sorted((repr(i), np.array([*encoding.encode_ordinary(t or ""), 50_256], "<u2").tobytes()) for i, t, *_ in ROWS)
    again = sequence_packing.unpack(spark.createDataFrame(packed, sequence_packing.ROW_SCHEMA), 2).collect()
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in again) == want
    for r in packed:
        assert len(r.ids) == 2 * length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert r.resets == [p * length for p in r.pieces]
    assert sum(r.n_tokens for r in packed) == sum(len(x) for _, x in want) // 2
    assert sequence_packing.pack(documents(spark, []), path, pattern, 50_256, length).count() == 0


def test_room_tree_takes_the_least_room_that_fits():
    draw = random.Random(2)
    for length in (1, 7, 32, 33):
        sizes = [draw.randint(1, length) for _ in range(200)]
        rooms, rows = [], 0
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            rows += not fits
            rest = (min(fits) if fits else length) - size
            if fits:
                rooms.remove(min(fits))
            if rest:
                rooms.append(rest)
        found = sequence_packing.best_fit(sizes, length)
        assert len(found) == rows and sorted(i for r in found for i in r) == list(range(200))
        assert all(sum(sizes[i] for i in r) <= length for r in found)


@pytest.mark.parametrize("run", [" ", "\n", "\r\n\t ", "\u3000", "a", "#", "7", "é!"])
def test_ids_of_long_runs_are_those_of_the_pattern(run):
    """Against the pattern applied by another library and its pieces encoded one by one."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = sequence_packing.byte_vocabulary(path, public_tokenizers.PATTERN)
    for text in (run * 9_000, "start" + run * 9_000 + "end", run * 5_000 + " x " + run * 5_000 + ".", "a" + run * 4_095 + "b", f"{run * 6_000}'s"):
        pieces = regex.findall(public_tokenizers.PATTERN, text)
        assert "".join(pieces) == text
        whole = tiktoken.Encoding("whole", pat_str=r"(?s:.)+", mergeable_ranks=plain._mergeable_ranks, special_tokens={})
        assert sequence_packing.encode_text(text, path, public_tokenizers.PATTERN) == [i for p in pieces for i in whole.encode_ordinary(p)]


@pytest.mark.parametrize("run", [" ", "\n", " \t", "a", "#", "1"])
def test_no_text_is_too_long_for_the_encoder(run):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = "start" + run * (2_000_000 // len(run)) + "end"
    ids = sequence_packing.encode_text(text, path, public_tokenizers.PATTERN)
    assert sequence_packing.byte_vocabulary(path, public_tokenizers.PATTERN).decode(ids) == text
