"""Feature matrices packed into archives and read back by byte range.

An archive is a plain ZIP file without compression, an entry an ``.npy`` matrix (frames x dims) named after its sample.
A location is ``archive:offset:length`` of the matrix's bytes, so a loader opens nothing but that range. Tasks write
archives of about ``ARCHIVE_BYTES`` with names of their own and hand the locations on as rows: what a failed or repeated
attempt leaves behind is named by no index. Two ways lead back: :func:`fetch` reads the ranges of an index, and the data
source ``packed_features`` scans a folder in byte ranges, each task the entries that begin in its range.

Archives are opened with Arrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
#: Bytes of a local file header before the name, as the format fixes them.
LOCAL_HEADER = 30
#: Bytes of a matrix that hold its shape.
NPY_HEADER = 128
SCHEMA = "id string, location string, n_frames long, frames array<array<float>>"


def _matrix_bytes(frames: list) -> tuple[bytes, int]:
    matrix = np.array(frames, np.float32)
    matrix = matrix if matrix.ndim == 2 else matrix.reshape(len(frames), 0)
    buffer = io.BytesIO()
    np.save(buffer, matrix)
    return buffer.getvalue(), len(matrix)


class _Archive:
    """An archive that grows in memory and goes to its folder when it is full."""

    def __init__(self, folder: str) -> None:
        self.path = posixpath.join(folder, f"{uuid.uuid4().hex}.zip")
        self.buffer = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.rows: list[tuple[str, str, int]] = []

    def add(self, name: str, frames: list) -> None:
        raw, n_frames = _matrix_bytes(frames)
        entry = zipfile.ZipInfo(quote(name, safe="") + ".npy")
        self.zip.writestr(entry, raw)
        start = entry.header_offset + LOCAL_HEADER + len(entry.filename.encode())
        self.rows.append((name, f"{self.path}:{start}:{len(raw)}", n_frames))

    def close(self) -> pa.RecordBatch:
        self.zip.close()
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(posixpath.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(self.buffer.getbuffer())
        ids, locations, counts = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids), "location": pa.array(locations), "n_frames": pa.array(counts, pa.int64())})


def pack_features(df: DataFrame, folder: str, key: str = "id", frames: str = "frames", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the matrices (arrays of frames) into archives below ``folder``; the rows are the index (id, location, n_frames).

    Write the index down: reading it a second time would pack a second time. Ids are text and not null; rows without a
    matrix are left out; frames of unequal length fail the job.
    """
    def task(batches: Iterator[pa.RecordBatch]):
        archive = None
        for batch in batches:
            for name, matrix in zip(batch.column(0), batch.column(1), strict=True):
                archive = archive or _Archive(folder)
                archive.add(name.as_py(), matrix.as_py())
                if archive.buffer.tell() >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive is not None:
            yield archive.close()

    rows = df.select(F.col(key).cast("string"), F.col(frames).cast("array<array<float>>")).dropna()
    return rows.mapInArrow(task, "id string, location string, n_frames long")


def fetch(index: DataFrame, location: str = "location", name: str = "frames") -> DataFrame:
    """Add the matrix at ``location``; each archive's ranges are read in order, and nothing else of it."""
    part = lambda i: F.regexp_extract(F.col(location), r"^(.*):(\d+):(\d+)$", i)
    ranged = index.withColumns({"_file": part(1), "_start": part(2).cast("bigint"), "_length": part(3).cast("bigint")})
    laid = ranged.repartitionByRange("_file", "_start").sortWithinPartitions("_file", "_start")
    schema = T.StructType([*laid.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.FloatType())))])

    def task(batches: Iterator[pa.RecordBatch]):
        ranges = Ranges()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_file", "_start", "_length")]
            found = [ranges.matrix(*at).tolist() for at in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.float32())))], schema=pa.schema([*batch.schema, (name, pa.list_(pa.list_(pa.float32())))]))
        ranges.close()

    return laid.mapInArrow(task, schema).drop("_file", "_start", "_length")


class Ranges:
    """Byte ranges of archives; one archive is open at a time. ``bytes_read`` counts what was read."""

    def __init__(self) -> None:
        self.path, self.file, self.bytes_read = None, None, 0

    def read(self, path: str, start: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            system, inner = fs.FileSystem.from_uri(path)
            self.path, self.file = path, system.open_input_file(inner)
        raw = self.file.read_at(length, start)
        self.bytes_read += len(raw)
        return raw

    def matrix(self, path: str, start: int, length: int) -> np.ndarray:
        return np.load(io.BytesIO(self.read(path, start, length)), allow_pickle=False)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


class _Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.whole = str(options.get("frames", "true")).lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for given in filters:
            if isinstance(given, (EqualTo, In)) and given.attribute == ("id",):
                asked = set(given.value) if isinstance(given, In) else {given.value}
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield given

    def partitions(self):
        """Byte ranges of the archives, from their sizes alone."""
        system, inner = fs.FileSystem.from_uri(self.folder)
        prefix = self.folder[: len(self.folder) - len(inner)] if self.folder.endswith(inner) else ""
        found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".zip"))
        return [_Split(prefix + path, start, start + self.split) for path, size in files for start in range(0, size, self.split)] or [_Split("", 0, 0)]

    def read(self, partition: _Split):
        if not partition.path:
            return
        system, inner = fs.FileSystem.from_uri(partition.path)
        ranges = Ranges()
        with system.open_input_file(inner) as file:
            entries = zipfile.ZipFile(file).infolist()
        for entry in entries:
            name = unquote(entry.filename.removesuffix(".npy"))
            if not partition.start <= entry.header_offset < partition.stop or (self.wanted is not None and name not in self.wanted):
                continue
            start = entry.header_offset + LOCAL_HEADER + len(entry.filename.encode())
            location = f"{partition.path}:{start}:{entry.file_size}"
            if self.whole:
                matrix = ranges.matrix(partition.path, start, entry.file_size)
                yield name, location, len(matrix), matrix.tolist()
            else:
                yield name, location, _frames_of(ranges.read(partition.path, start, min(NPY_HEADER, entry.file_size))), None
        ranges.close()


def _frames_of(head: bytes) -> int:
    stream = io.BytesIO(head)
    np.lib.format.read_magic(stream)
    return np.lib.format.read_array_header_1_0(stream)[0][0]


class PackedFeatures(DataSource):
    """``spark.read.format("packed_features").load(folder)``: id, location, n_frames, frames.

    ``splitBytes`` is what a task takes of an archive; ``frames=false`` reads the shapes only, a few bytes an entry. Conditions
    on ``id`` (equal, in) reach the source: other entries are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the data source known to a session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedFeatures)
