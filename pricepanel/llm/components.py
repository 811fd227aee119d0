"""Connected components by minimum labels and pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricepanel.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), two longs each; the
    component is the smallest node that can be reached. A round takes the least
    label among the neighbours and then that label's own label, so paths halve.
    Labels are written between rounds: no lineage grows, and nothing is collected
    but the number of changes. A hot node is split by skew joins or combined
    before a shuffle."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = stored(
            lower.join(jump, "low").select("node", F.least("low", "far").alias("component"), F.col("was")), "labels"
        )
        labels = after.select("node", "component")
        if not after.filter("was <> component").limit(1).count():
            return labels
