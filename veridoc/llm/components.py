"""Connected components of an edge table, in the shared folder, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.sources import scratch


def connected(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges`` (columns ``a`` and ``b``, any orderable type) with its component's least node.

    Each round takes the least label among neighbours and then jumps to the label's own label, so a path of n nodes
    takes about log n rounds. A round is two joins that AQE can split where a node has very many neighbours, and one
    aggregation that combines before the shuffle. Labels of each round are written to the shared folder.
    Returns ``node`` and ``label``; nodes without an edge are not listed. Self-loops and repeated edges are harmless.
    """
    both = scratch.keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        low = labels.union(seen).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        jumped = low.join(up, "label", "left").select("node", F.least("label", F.coalesce("over", "label")).alias("label"))
        after = scratch.keep(jumped, "labels")
        changed = after.join(labels, ["node", "label"], "left_anti").limit(1).count()
        scratch.drop(labels)
        labels = after
        if not changed:
            scratch.drop(both)
            return labels
