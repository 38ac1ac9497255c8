"""Connected components by label propagation with pointer jumping, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long). component is the least node that it is connected to.

    Each round takes the least label among a node and its neighbours, then that label's own label. Labels are written to
    the shared folder every round, so a lost executor costs no more than one round. The driver sees one count a round.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        new = labels.join(heard, "node", "left").select("node", F.least("component", F.coalesce("heard", "component")).alias("next"), F.col("component").alias("was"))
        new = store(new, "labels")
        up = new.select(F.col("node").alias("next"), F.col("next").alias("up"))
        jumped = store(new.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("component"), "was"), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
