"""Connected components as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of `edges` (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then that label's own
    label; rounds end when no label changes.  A round's labels are written to the shared folder, which cuts
    the lineage; minima are taken before the shuffle, so a node with very many neighbours is no hot spot.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("taken"))
        jump = labels.select(F.col("node").alias("taken"), F.col("component").alias("beyond"))
        labels = materialize(taken.join(jump, "taken").select("node", F.least("taken", "beyond").alias("component"), (F.least("taken", "beyond") < F.col("component")).alias("changed")), "labels")
        if not labels.where("changed").limit(1).count():
            return labels.select("node", "component")
        labels = labels.drop("changed")
