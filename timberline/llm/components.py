"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberline.llm.common import cut


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Label of every node: the smallest node it is linked to, over any number of links.

    ``nodes`` has a column ``node``, ``links`` columns ``a`` and ``b``. Each round takes the smallest label among the
    neighbours, then the label of that label, so rounds grow with the logarithm of the longest chain. In the first round
    nodes are their own labels, so nothing is joined for it. Labels stay in tables; only whether any has changed
    reaches the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels, told = nodes.select("node", F.col("node").alias("label")), both.withColumn("label", F.col("b"))
    while True:
        near = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("_jump"))
        new = cut(lower.join(jump, "label", "left").select(
            "node", "_old", F.least("label", "_jump").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label <> _old").isEmpty():
            return labels
        told = both.join(labels, both["b"] == labels["node"])
