"""A content-addressed WARC archive: payloads once by digest, exact record headers beside them.

``archive`` writes two tables: ``payloads`` (digest, payload; one row for each distinct payload) and
``headers`` (record id, the exact header block, digest). Joined on the digest they give back the original
records. A digest stands for its bytes only after a check: all payloads that share a SHA-256 must share
their length and two checksums of another kind, else the job fails.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the smallest id is a
``response`` and the others are ``revisit`` records that refer to it; shorter payloads are always
responses. A null payload is empty. A null id sorts after all ids, has the record id ``none`` and is a
revisit where some record has an id, else a response. Rows that repeat id and payload are records of their
own, and responses alike if theirs is the smallest id. Columns besides id, address and payload are not
archived.

``export_warc`` writes the records as gzipped WARC/1.1 files, and ``import_warc`` splits such files again: revisit records
have no block there, so the files hold a large payload once too. ``described_files`` reads an archive back from its files alone.

Payloads are reduced to one of each digest before they are shuffled and are stored in buckets by digest, so a payload that a
third of all pages share is one row a task, and the joins that rebuild the records shuffle headers only. Revisit records take no
part in those joins. The bucket count follows from the bytes stored, so a bucket is about one file of ``FILE_BYTES``.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.unions import stack_rows
from corpusflow.session import written

MIN_REVISIT = 100
CRLF = "\r\n"
#: Bytes of records in an exported file, about; a reader holds one file in memory.
FILE_BYTES = 32 * 1024 * 1024
#: Bytes of payload that a reader hands on at a time.
CHUNK_BYTES = 4 * 1024 * 1024


def _record_uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header_block(date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    uri = F.regexp_replace("url", r"[\r\n]", " ")
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_uri(F.col("refers_to")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def records(pages: DataFrame, date: str) -> DataFrame:
    """One row for each page: id, header block, digest, payload, record type, what it refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    odd = (F.min("payload_bytes") != F.max("payload_bytes")) | (F.min("check1") != F.max("check1")) | (F.min("check2") != F.max("check2"))
    first = rows.select("page_id", "digest", "payload_bytes", F.crc32("payload").alias("check1"), F.xxhash64("payload").alias("check2")).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.when(odd, F.raise_error(F.lit("payloads differ under one digest"))).otherwise(F.lit(True)).alias("checked")
    )
    later = F.col("checked") & (F.col("payload_bytes") >= MIN_REVISIT) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.join(first, "digest")
        .withColumn("record_type", F.when(later, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(later, F.col("first_id")))
        .withColumn("header", _header_block(date).cast("binary"))
        .select("page_id", "header", "digest", "payload_bytes", "record_type", "refers_to", "payload")
    )


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))


def archive(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``headers`` and ``payloads`` below ``folder``; copies of a payload go before the shuffle."""
    spark = pages.sparkSession
    records(pages, date).drop("payload").write.parquet(f"{folder}/headers")
    headers = spark.read.parquet(f"{folder}/headers")
    held = headers.groupBy("digest").agg(F.max("payload_bytes").alias("n"))
    size = held.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-size // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20))))
    one = _payloads(pages).groupBy("digest").agg(F.first("payload").alias("payload"))
    laid = one.repartition(int(buckets), "digest")
    writer = laid.write.format("parquet").option("compression", "zstd").bucketBy(int(buckets), "digest")
    writer.option("path", f"{folder}/payloads").saveAsTable(_table(folder))


def _table(folder: str) -> str:
    """A name in the session's catalogue, which knows the buckets."""
    return f"payloads_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"


def _stored_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads, by bucket where this session has written them."""
    if spark.catalog.tableExists(_table(folder)):
        return spark.table(_table(folder))
    return spark.read.parquet(f"{folder}/payloads")


def reconstruct(spark: SparkSession, folder: str, *of_payload: Column) -> DataFrame:
    """The original records: ids and exact headers joined with what their digests name.

    Without ``of_payload`` that is the payload itself; else these expressions over it, which are then
    evaluated once for each stored payload and joined in its place.
    """
    headers = spark.read.parquet(f"{folder}/headers").select("page_id", "header", "digest")
    return _with_payload(spark, folder, headers, *of_payload)


def _with_payload(spark: SparkSession, folder: str, headers: DataFrame, *of_payload: Column) -> DataFrame:
    """Headers are gathered by digest and payloads stream past them where they lie."""
    stored = _stored_payloads(spark, folder).select("digest", *(of_payload or [F.col("payload")]))
    return headers.hint("shuffle_hash").join(stored, "digest")


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null where the block has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def described(spark: SparkSession, folder: str) -> DataFrame:
    """What the archived records say when they are read back: type, what they refer to, and the length and digest of
    the payload bytes, computed anew."""
    rows = reconstruct(
        spark, folder, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    header = F.col("header").cast("string")
    page = lambda name: F.regexp_extract(header_field(header, name), r"<urn:page:(-?\d+)>", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    holds = header_field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha256:"), F.col("payload_digest"))
    return rows.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        F.when(holds, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest"))).alias("payload_digest"),
        header_field(header, "WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
    )


def described_files(spark: SparkSession, source: str) -> DataFrame:
    """What the records in WARC files say: type, what they refer to, length and digest of the payload bytes, computed anew.

    A revisit record has the payload of the response that has its digest; without one the job fails.
    """
    header = F.col("header").cast("string")
    page = lambda name: F.regexp_extract(header_field(header, name), r"<urn:page:(-?\d+)>", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    read = written(
        import_warc(spark, source).select(
            number(page("WARC-Record-ID")).alias("page_id"),
            header_field(header, "WARC-Type").alias("record_type"),
            number(page("WARC-Refers-To")).alias("refers_to"),
            header_field(header, "WARC-Payload-Digest").alias("declared"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    holds = F.col("declared") == F.concat(F.lit("sha256:"), F.col("payload_digest"))
    checked = lambda fine, message: F.when(fine, F.col("payload_digest")).otherwise(F.raise_error(F.lit(message)))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = read.filter("record_type = 'response'").withColumn("payload_digest", checked(holds, "a payload does not have its digest"))
    later = read.filter("record_type <> 'response'").drop("payload_bytes", "payload_digest")
    held = own.groupBy("declared").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    found = later.join(held, "declared", "left")
    found = found.withColumn("payload_digest", checked(F.col("payload_digest").isNotNull(), "a revisit record's payload is in no response"))
    return stack_rows(own.select(*columns), found.select(*columns))


def export_warc(spark: SparkSession, folder: str, target: str) -> None:
    """The archive as WARC/1.1 files, a bucket of payloads in each. The text writer ends each record with two line breaks."""
    headers = spark.read.parquet(f"{folder}/headers")
    whole = _with_payload(spark, folder, headers.filter("record_type = 'response'").select("header", "digest"))
    whole = whole.select(F.concat("header", "payload").cast("string").alias("value"))
    bare = headers.filter("record_type <> 'response'").select(F.col("header").cast("string").alias("value"))
    for rows in (whole, bare):
        rows.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").text(target)


def _split_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at) + 4
        header = content[at:body]
        length = int(header.lower().split(b"\r\ncontent-length:")[1].split(b"\r\n")[0])
        if content[body + length : body + length + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        yield header, content[body : body + length]
        at = body + length + 4


def import_warc(spark: SparkSession, source: str) -> DataFrame:
    """(header, payload) of each record in WARC files, gzipped or not, read whole file by whole file."""
    kind = pa.schema([("header", pa.binary()), ("payload", pa.binary())])

    def task(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                held: list[dict] = []
                size = 0
                for header, payload in _split_records(raw):
                    held.append({"header": header, "payload": payload})
                    size += len(header) + len(payload)
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return spark.read.format("binaryFile").load(source).select("content").mapInArrow(task, "header binary, payload binary")
