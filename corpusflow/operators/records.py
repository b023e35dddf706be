"""A user's function that makes many rows of one record, as a table function: all of a record's rows or its error."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F, types as T


def explode_records(df: DataFrame, fn: Callable[[object], Iterable[tuple]], column: str, row_type: T.StructType | str, keep: bool = False) -> DataFrame:
    """Each row of ``df`` joined with the rows that ``fn`` makes of ``column``, and ``error``.

    A record on which fn raises, even after it has made some rows, gives one row of nulls with the reason; a record of which
    it makes nothing gives no row. The record itself does not come back unless ``keep`` asks for it. ``row_type``
    names the columns; they must not be among those of ``df``.
    """
    fields = T.StructType.fromDDL(row_type) if isinstance(row_type, str) else row_type
    width = len(fields)
    result = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("error", T.StringType())])

    class Exploded:
        def eval(self, record):
            try:
                rows = [(*row, None) for row in fn(record)]
                if any(len(row) != width + 1 for row in rows):
                    raise ValueError(f"rows of {width} values are wanted")
            except Exception as failure:  # whatever the user's function does, the job goes on
                rows = [(*[None] * width, f"{type(failure).__name__}: {failure}")]
            yield from rows

    table = F.udtf(Exploded, returnType=result, useArrow=True)
    joined = df.lateralJoin(table(F.col(column).outer()))
    return joined if keep else joined.drop(column)
