"""Connected components of a graph kept in DataFrames.

In each round a node points to the least of itself and its neighbours, pointers
are followed to their ends, and links are drawn between those ends: what has met
is one node from then on, so links only get fewer, and a star or a chain of any
size is left with none after a round or two. Every step is written to the shared
folder, so lineage stays short; links and labels never go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import written

MAX_ROUNDS = 64


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (columns a, b); the label is the least node of its component."""
    labels, edges = None, written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        found = _ends(written(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels"))
        labels = found if labels is None else written(relabelled(labels, found), "labels")
        side = lambda c, found=found: found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        left = edges.join(side("a"), "a").join(side("b"), "b").where("la != lb")
        edges = written(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (a column label and others) with each label that is a node of ``found`` (node, label) replaced by its own label."""
    new = found.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return labels.join(new, "label", "left").select(*[F.coalesce("_new", "label").alias(c) if c == "label" else c for c in labels.columns])


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, label) with the node at which the pointers (node, label) from each node end: their lengths double each time."""
    for _ in range(MAX_ROUNDS):
        on = pointers.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = written(pointers.withColumnRenamed("label", "mid").join(on, "mid").select("node", F.col("mid").alias("old"), F.col("far").alias("label")), "labels")
        pointers = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return pointers
    raise RuntimeError("pointers did not end")
