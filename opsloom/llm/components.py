"""Connected components of a graph given as edges, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opsloom.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge: the least node of its component.

    Each round takes the least label among a node's neighbours, then follows
    labels to the labels of their labels, and writes the result to the shared
    folder; it ends when nothing changed.  Minima are pre-aggregated before
    each shuffle, and both sides of each join are plain scans, so that adaptive
    execution can split the rows of a hub.  No row reaches the driver but the
    number of changes.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = both.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near"))).distinct()
    both = cut_lineage(both, "edges")
    labels = both.groupBy("node").agg(F.min("near").alias("label"))
    labels = cut_lineage(labels.withColumn("label", F.least("node", "label")), "labels")
    while True:
        named = labels.select(F.col("node").alias("near"), "label")
        heard = both.join(named, "near").select("node", "label").unionByName(labels)
        # a neighbour's label is also told to the label itself: whole trees move at once
        told = heard.join(labels.select("node", F.col("label").alias("old")), "node").select(F.col("old").alias("node"), "label")
        least = cut_lineage(heard.unionByName(told).groupBy("node").agg(F.min("label").alias("label")), "heard")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut_lineage(least.join(jump, "label").select("node", F.col("further").alias("label")), "labels")
        changed = moved.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old"))
        if changed.isEmpty():
            return moved
        labels = moved
