"""Connected components of an edge table, with nothing but tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of settled ``edges`` (a, b): the smallest node that each can reach.

    A round takes the least label among the neighbours and then the label of the label, so that paths shorten by
    more than half; rounds end when no label changes.  Labels go to the shared folder after each round, and the
    joins are between plain tables, which lets Spark split the rows of a node with very many edges.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = settle(labels.join(near, labels.node == near.a, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component")), "labels")
        up = lower.select(F.col("node").alias("up"), F.col("component").alias("top"))
        after = settle(lower.join(up, lower.component == up.up).select("node", F.col("top").alias("component")), "labels")
        moved = after.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        forget(labels, lower)
        labels = after
        if not moved:
            forget(both)
            return labels
