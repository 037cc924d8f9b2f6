"""Connected components over a table of edges, in rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node each node of `edges` (a, b; longs) can reach.

    Every round takes the least label over a node's neighbours and then the label of that label,
    so paths halve. Only the number of changed rows comes to the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node <> other")
    both = cut_lineage(both.union(both.select("other", "node")).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
