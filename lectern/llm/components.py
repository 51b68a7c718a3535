"""Connected components of a link table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node and label (the component's smallest node) of every node of ``links`` (a, b).

    Each round takes the smallest label around a node and then the label of that label, so chains
    shorten by half.  Only counts of changes reach the driver; labels live in checkpoints.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        step = cut(step)
        up = step.select(F.col("node").alias("root"), F.col("next").alias("above"))
        jumped = cut(step.join(up, step["next"] == up["root"]).select("node", F.least("next", "above").alias("label"), (F.least("next", "above") < F.col("label")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels
