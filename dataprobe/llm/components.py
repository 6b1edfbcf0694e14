"""Connected components by smallest label, with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.session import written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with the smallest label that any node reachable over ``links(a, b)`` started with.

    ``nodes(node, label)`` has unique nodes.  A round takes the smallest label next door and then that label's own
    label, so long chains fold up instead of being walked.  Messages are reduced before they are shuffled; a hub's
    links are only ever joined, never gathered.  Links are few rows and are stored once in both directions.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    touched = both.select(F.col("a").alias("node")).distinct()
    part = written(nodes.join(touched, "node"), "labels")
    # labels are carried as the node that owns them, so that a label can be followed
    state = written(part.select("node", F.struct("label", "node").alias("root")), "roots")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = state.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        owners = state.select(F.col("node").alias("owner"), F.col("root").alias("next"))
        jumped = stepped.withColumn("owner", F.col("root.node")).join(owners, "owner")
        after = written(jumped.select("node", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("old")).alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        state = after.drop("moved")
        if not moved:
            break
    labels = state.select("node", F.col("root.label").alias("found"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("found", "label").alias("label"))
