"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (id long, component long): the smallest id that each endpoint reaches.

    Each round takes the least label of a node's neighbours, then the label of that label. Both steps are
    joins and partial aggregates, so a hub's edges are combined before they move. Tables of each round
    go to the shared folder. An empty edge table gives an empty result; loops and repeated edges are harmless.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "id").select("id", F.least("component", "seen").alias("next"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("further"))
        new = written(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("further", "next")).alias("component"), "before"), "cc-labels")
        changed = new.filter("component <> before").limit(1).count()
        forget(labels)
        path, labels = new._quillon_path, new.select("id", "component")
        labels._quillon_path = path
        if not changed:
            forget(both)
            return labels
