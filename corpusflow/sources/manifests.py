"""Tab-separated manifests: quoting is off and every column is text until it is cast."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusflow.operators.unions import stack_rows

_READ = {"sep": "\t", "header": True, "quote": "", "escape": "\0", "mode": "FAILFAST", "enforceSchema": False, "maxCharsPerColumn": -1, "columnPruning": False}
_WRITE = {
    "sep": "\t",
    "header": True,
    "quote": "",
    "escape": "\0",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
#: The file a row was read from, inside this module.
FILE = "_file"
_UNSAFE = r"[\t\n\r\x{0}]"


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _header(spark: SparkSession, path: str) -> list[str]:
    """The field names of one manifest: the first line of the folder's or file's first file.

    A few bytes through the cluster's own file system, and no job: a grid has as many manifests as cells.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    given = hadoop.fs.Path(path)
    fs = given.getFileSystem(conf)
    found = fs.globStatus(given)
    if not found:
        spark.read.text(path)  # raises, with the name of what is missing
        raise FileNotFoundError(path)
    hidden = lambda inner: any(part.startswith(("_", ".")) and "=" not in part for part in inner.split("/"))
    for status in found:
        files = fs.listFiles(status.getPath(), True)
        names = []
        while files.hasNext():
            file = files.next().getPath()
            if not hidden(str(file.toString()).removeprefix(str(status.getPath().toString()))):
                names.append(file)
        for file in sorted(names, key=lambda f: f.toString()):
            stream = fs.open(file)
            try:
                codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
                source = codec.createInputStream(stream) if codec is not None else stream
                java = spark._jvm.java.io
                line = java.BufferedReader(java.InputStreamReader(source, "UTF-8")).readLine()
            finally:
                stream.close()
            if line is not None:
                return line.split("\t")
    return []


def read_manifest_tsv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], optional: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Read manifests by header name; a line of the wrong width fails the read.

    Each path has one header, in its own order, and may hold more columns than are asked for. A
    column of ``columns`` that a header lacks fails the read; one of ``optional`` takes its default
    there. Partition folders give columns as usual. The format cannot tell an empty field from a
    missing one; both come back null. One line of each path is read to learn its header, paths that
    share a header are one scan.
    """
    return _read(spark, [path] if isinstance(path, str) else path, columns, optional or {}).drop(FILE)


def _read(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], optional: Mapping[str, str | None]) -> DataFrame:
    by_header: dict[tuple[str, ...], list[str]] = {}
    for one in paths:
        by_header.setdefault(tuple(_header(spark, one)), []).append(one)
    parts = []
    for header, same in by_header.items():
        raw = spark.read.schema(_text_schema(header)).options(**_READ).csv(same if len(same) > 1 else same[0])
        lacking = [c for c in columns if c not in raw.columns]
        if header and lacking:
            raise ValueError(f"{same[0]} has no column {', '.join(lacking)}")
        fields = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
        fields += [F.coalesce(c, F.lit(v)).alias(c) if c in raw.columns else F.lit(v).cast("string").alias(c) for c, v in optional.items()]
        parts.append(raw.select(*fields, F.col("_metadata.file_path").alias(FILE)))
    return stack_rows(*parts) if len(parts) > 1 else parts[0]


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed, rejected): a row whose field does not read as its type is set aside as text."""
    ok = F.lit(True)
    for name, kind in types.items():
        ok = ok & (F.col(name).isNull() | F.col(name).try_cast(kind).isNotNull())
    typed = df.filter(ok).withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items()})
    return typed, df.filter(~ok)


def scan_manifest_grid(
    spark: SparkSession, pattern: str, cells: Iterable[tuple[str, str]], columns: Sequence[str]
) -> DataFrame:
    """Read one manifest per (language, split) cell and tag rows with both.

    ``pattern`` is a path with ``{lang}`` and ``{split}``. One scan for each distinct header; a cell
    without a manifest is an error. A full grid is ``itertools.product(langs, splits)``.
    """
    paths = [pattern.format(lang=lang, split=split) for lang, split in cells]
    raw = _read(spark, paths, columns, {})
    cell = re.escape(pattern).replace(re.escape("{lang}"), "([^/]+)").replace(re.escape("{split}"), "([^/]+)")
    lang_at, split_at = (1, 2) if pattern.index("{lang}") < pattern.index("{split}") else (2, 1)
    file = F.col(FILE)
    return raw.select(
        *columns,
        F.regexp_extract(file, cell, lang_at).alias("lang"),
        F.regexp_extract(file, cell, split_at).alias("split"),
    )


def split_tsv_safe(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writable, rejected): text with a tab or line break cannot be held by the format."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    unsafe: Column = F.lit(False)
    for name in text:
        unsafe = unsafe | F.coalesce(F.col(name).rlike(_UNSAFE), F.lit(False))
    return df.filter(~unsafe), df.filter(unsafe)


def write_manifest(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = ("split",)) -> None:
    """Write one manifest folder per split with a fixed column order.

    Text the format cannot hold fails the job; :func:`split_tsv_safe` sets it aside beforehand.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def checked(name: str) -> Column:
        if not isinstance(kinds[name], T.StringType):
            return F.col(name)
        broken = F.raise_error(F.lit(f"tab or line break in column {name}"))
        return F.when(F.col(name).rlike(_UNSAFE), broken).otherwise(F.col(name)).alias(name)

    writer = df.select(*[checked(c) for c in columns], *by).write.options(**_WRITE)
    if by:
        writer = writer.partitionBy(*by)
    writer.csv(path)


def replace_manifest(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = ("split",)) -> str:
    """Rewrite a manifest that ``df`` may have been read from: write beside it, then swap.

    The old version is kept; its path is returned.
    """
    mark = uuid.uuid4().hex
    staged, kept = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write_manifest(df, staged, columns, by)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(target, hadoop.Path(kept)):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(hadoop.Path(staged), target):
        back = fs.rename(hadoop.Path(kept), target)
        raise OSError(f"could not move {staged} to {path}; the old version is {'back in place' if back else f'at {kept}'}")
    return kept
