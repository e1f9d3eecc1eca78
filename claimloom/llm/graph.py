"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, group) for every node of the edges (a, b); group is the smallest node.

    Each round a node takes the smallest label around it, then its label's label,
    so chains shrink by half.  Every round's labels are written to the shared
    folder, and the rounds end when no label has changed.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "edges")
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group")),
        "labels",
    )
    last = labels
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("m"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("group").alias("old"), F.least("group", "m").alias("group")
        )
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("far"))
        jumped = lower.join(jump, "group", "left").select(
            "node", "old", F.least("group", F.coalesce("far", "group")).alias("group")
        )
        jumped = stage(jumped, "labels")
        unstage(last)
        last, labels = jumped, jumped.select("node", "group")
        if jumped.where("old <> group").isEmpty():
            unstage(both)
            return labels
