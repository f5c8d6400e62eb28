"""Connected components of links by joins: label minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Each round takes the smallest label among the neighbours, then the label's own label, so a chain of
    length L needs about log L rounds. Labels are written to the shared folder every round. A hub's
    neighbours are reduced by minimum before the shuffle; nothing is gathered per node.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store(both.where(~F.col("a").eqNullSafe(F.col("b"))).distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", "near").alias("low"))
        step = store(step)
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("next"))
        # Every root is a node, so the inner join keeps all rows.
        moved = store(step.join(jump, step["low"] == jump["at"]).select("node", "root", F.least("low", "next").alias("new")))
        changed = moved.where(F.col("new") != F.col("root")).limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
