"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, component)``, the smallest node that each node reaches.

    Each round every node takes the least label among its own and its neighbours', then the label of that
    label (pointer jumping), so the rounds grow with the logarithm of the longest chain. Labels are written
    to the shared folder each round. Only nodes with a link appear; no links give an empty table.
    Sums by key combine before the shuffle and joins stay plain equi-joins, which adaptive execution splits
    when a node has very many links.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        took = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("took"))
        of = labels.select(F.col("node").alias("took"), F.col("label").alias("further"))
        after = materialize(
            took.join(of, "took").select("node", F.col("label").alias("before"), F.least("took", "further").alias("label"))
        )
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
