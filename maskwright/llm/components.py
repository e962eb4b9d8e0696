"""Connected components by minimum labels with pointer jumping, on joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the smallest node that it reaches.

    Each round takes the smallest label of all neighbours and then the label's own label; both are partial aggregations
    and joins, so a node with very many links is combined before it is shuffled. Every round is a table in the shared
    folder. Ends when a round changes nothing. No links give no rows; nulls in a or b are no links.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both = staged(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("least"))
        lower = labels.join(near, labels.node == near.n, "left").select("node", F.least("label", "least").alias("label"))
        ends = labels.select(F.col("node").alias("at"), F.col("label").alias("end"))
        jumped = staged(lower.join(ends, lower.label == F.col("at"), "left").select(
            "node", F.least("label", "end").alias("label")), "labels")
        was = labels.select(F.col("node").alias("n"), F.col("label").alias("was"))
        done = jumped.join(was, F.col("node") == F.col("n")).where("label < was").isEmpty()
        discard(labels)
        labels = jumped
        if done:
            discard(both)
            return labels
