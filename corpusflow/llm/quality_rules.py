"""Quality rules whose limits come from the corpus: quantile sketches for each language and source.

Every whole text is measured: words, characters in words, symbols, lines equal to an earlier line, words inside
repeated ``WINDOW``-word windows. A text with few words or mostly repeated ones fails outright. Of the others four
measures are sketched for each (language, source): a sketch counts the values of each bucket, buckets being whole
numbers up to ``2 * GRAIN`` and from there a constant share of the value (1/64), so any two sketches merge by adding
counts, in any order, with the same result. Limits are fences on its quartiles. A source with fewer than
``LEAST_ROWS`` texts merges into its language's sketch for its limits, a language with fewer into that of the
whole corpus. Documents meet their limits in a join.

Measures are taken where the texts lie and only they are written and joined; texts are never shuffled. Counts of
buckets are made before the shuffle, so a source that is a third of all rows sends a few hundred rows a task. A
sketch has at most about 3,700 buckets a measure.

Words are runs of other characters than space and \\t to \\r. A null text has none, like an empty one, and fails. A
null language or source is a value of its own. Repeated ids and rows are judged each. Other columns pass through
:func:`accepted`, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import slices
from corpusflow.session import written

SPACE = " \t\n\v\f\r"
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Hundredths of the words that may lie in repeated windows.
MOST_REPEATED = 30
#: Values below twice this are buckets of their own.
GRAIN = 64
LEAST_ROWS = 200
#: A fence lies this many times the distance of the quartiles (and the measure's slack) beyond them.
REACH = 3

#: The slack keeps groups whose quartiles are equal (most have no repeats at all) from failing every other text: one line
#: that comes twice among three must not.
#: measure -> (factor, count, count it is a share of, slack, whether small values fail as well)
MEASURES = {
    "word_length": (100, "word_chars", "n_words", 100, True),
    "symbols": (10_000, "n_symbols", "n_words", 500, False),
    "dup_lines": (10_000, "n_dup_lines", "n_lines", 1_500, False),
    "repeats": (10_000, "n_repeat_words", "n_words", 1_000, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that come twice or more. Windows are named by doubling, so equal names are equal words."""
    if len(ids) <= window:
        return 0
    step = 1
    while step < window:
        named = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        found, ids = np.unique(named, return_inverse=True)
        if len(found) == len(ids):
            return 0
        step *= 2
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(ids) + window, np.int64)
    edges[: len(ids)] += again
    edges[window : window + len(ids)] -= again
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at the same six characters
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0 if len(names) == len(words) else repeated_words(ids)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
    )


def measured(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """``docs`` with a struct of ``COUNTS`` and ``base_failed`` in place of the text; further columns stay."""
    counted = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            table = np.array([measure(x.as_py()) for x in batch.column(0)], np.int64).reshape(-1, len(COUNTS))
            struct = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(COUNTS))], list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(1), struct], ["row", "counts"])

    rest = [c for c in docs.columns if c not in (text, name)]
    numbered = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    rows = docs.select(F.col(text).cast("string").alias("text"), numbered.alias("row"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("counts", counted)])
    n, repeated = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)]
    return rows.mapInArrow(task, schema).select(*back, F.col("counts").withField("base_failed", failed).alias(name))


def value(measure_name: str, name: str = "measures") -> Column:
    """A measure as a whole number; null where there is nothing to share."""
    factor, part, whole, _, _ = MEASURES[measure_name]
    return F.expr(f"{factor} * {name}.{part} div nullif({name}.{whole}, 0)")


def bucket(value: Column) -> Column:
    """The least value of the bucket a whole number lies in."""
    shift = F.greatest(F.length(F.bin(value)) - (GRAIN.bit_length()), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source", name: str = "measures") -> DataFrame:
    """(lang, source, measure, low, n): how many texts that do not fail outright fall into each bucket.

    Sketches of further shards merge by :func:`merged`.
    """
    values = [F.struct(F.lit(m).alias("measure"), bucket(value(m, name)).alias("low")) for m in MEASURES]
    good = rows.filter(~F.col(f"{name}.base_failed"))
    one = good.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*values)).alias("at")).select("lang", "source", "at.*")
    return one.groupBy("lang", "source", "measure", "low").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches added up to one for each value of ``by``."""
    return sketch.groupBy(*by, "measure", "low").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, measure, rows, q1, q3) of each sketch: least bucket that a quarter and three quarters of the rows reach."""
    whole = Window.partitionBy(*by, "measure")
    upto = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    run = sketch.withColumns({"_upto": F.sum("n").over(upto), "_rows": F.sum("n").over(whole)})
    reached = lambda part: F.min(F.when(4 * F.col("_upto") >= part * F.col("_rows"), F.col("low")))
    return run.groupBy(*by, "measure").agg(F.first("_rows").alias("rows"), reached(1).alias("q1"), reached(3).alias("q3"))


def limits(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, and a struct ``measure`` (least, most) for each measure).

    A group of fewer than ``least_rows`` texts has the limits of its language, or of all.
    """
    levels = {"own": ("lang", "source"), "lang": ("lang",), "all": ()}
    of = {
        level: quartiles(sketch if level == "own" else merged(sketch, *by), *by).select(
            F.struct(*by, "measure").alias(f"_{level}_key"), F.struct("rows", "q1", "q3").alias(f"_{level}")
        )
        for level, by in levels.items()
    }
    keys = sketch.select("lang", "source", "measure").distinct()
    for level, by in levels.items():
        keys = keys.withColumn(f"_{level}_key", F.struct(*by, "measure")).join(of[level], f"_{level}_key")
    enough = lambda level: F.when(F.col(f"_{level}.rows") >= least_rows, F.col(f"_{level}"))
    chosen = keys.withColumn("q", F.coalesce(enough("own"), enough("lang"), F.col("_all")))
    slack = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, (_, _, _, s, _) in MEASURES.items()])
    both = F.coalesce(*[F.when(F.col("measure") == m, F.lit(two)) for m, (_, _, _, _, two) in MEASURES.items()])
    reach = REACH * (F.col("q.q3") - F.col("q.q1") + slack)
    fence = F.struct(F.when(both, F.col("q.q1") - reach).alias("least"), (F.col("q.q3") + reach).alias("most"))
    return chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES])


def judged(rows: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source", name: str = "measures") -> DataFrame:
    """``rows`` with ``kept`` added to the struct: not failed outright and inside all limits of the group."""
    key = lambda a, b: F.struct(a.alias("a"), b.alias("b"))  # noqa: E731  structs compare nulls as equal
    known = fences.select(key(F.col("lang"), F.col("source")).alias("_group"), F.struct(*MEASURES).alias("_limits"))
    joined = rows.withColumn("_group", key(F.col(lang), F.col(source))).join(known, "_group", "left")
    inside = F.lit(True)
    for m in MEASURES:
        least, most = F.col(f"_limits.{m}.least"), F.col(f"_limits.{m}.most")
        inside = inside & (value(m, name) <= most) & (least.isNull() | (value(m, name) >= least))
    kept = ~F.col(f"{name}.base_failed") & F.coalesce(inside, F.lit(False))
    return joined.withColumn(name, F.col(name).withField("kept", kept)).drop("_group", "_limits")


def score(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with its measures and the verdict in the struct ``measures``."""
    rows = written(measured(docs, text), "measures")
    return judged(rows, limits(sketches(rows, lang, source)), lang, source)


def accepted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Texts are read twice and not moved."""
    narrow = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    fences = written(limits(sketches(measured(narrow))), "limits")
    packed = docs.select(F.struct("*").alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    return judged(measured(packed), fences).filter("measures.kept").select("row.*")
