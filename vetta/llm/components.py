"""Connected components of a link table, by shrinking labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import discard, staged


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest ``name`` of each node's component.  ``nodes``
    has (node, name), ``links`` has (a, b) between nodes.  Every round takes the
    smallest label next door, then the label's own label, so paths halve; the
    tables of a round are written to the shared folder."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
                    .select("node", "name", F.col("name").alias("label")), "labels")
    while True:
        before = labels
        near = (both.join(labels.select(F.col("node").alias("a"), "label"), "a")
                .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near")))
        moved = labels.join(near, "node", "left").select(
            "node", "name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = moved.groupBy(F.col("name").alias("label")).agg(F.min("label").alias("ahead"))
        labels = staged(moved.join(ahead, "label", "left").select(
            "node", "name", "old", F.least("label", "ahead").alias("label")), "labels")
        discard(before)
        if labels.where("label <> old").isEmpty():
            discard(both)
            return labels.select("node", "label")
