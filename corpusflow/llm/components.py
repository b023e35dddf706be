"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import written



def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: long): the label is the least node it is connected with.

    Labels fall to the least label among neighbours, then to the label of their label, until none changes.
    Each round is a table in the shared folder. Edges of a node with very many neighbours lie on the side of a
    join that adaptive execution can split, and labels are reduced before they are shuffled.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Each node hands its lower neighbours on to the lowest of them: edges that say the same fall together.
    lowest = pairs.groupBy("b").agg(F.min("a").alias("low"))
    ends = F.explode(F.array("a", "b")).alias("end")
    star = written(pairs.join(lowest, "b").select("low", ends).filter("low <> end").distinct(), "star")
    ways = F.array(F.struct(F.col("low").alias("a"), F.col("end").alias("b")), F.struct(F.col("end").alias("a"), F.col("low").alias("b")))
    both = star.select(F.explode(ways).alias("e")).select("e.a", "e.b")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("at")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("root"), F.col("label").alias("beyond"))
        moved = written(
            step.join(jump, F.col("lower") == F.col("root")).select("node", F.least("lower", "beyond").alias("label"), (F.least("lower", "beyond") < F.col("label")).alias("fell")),
            "labels",
        )
        labels = moved.drop("fell")
        if moved.filter("fell").isEmpty():
            return labels
