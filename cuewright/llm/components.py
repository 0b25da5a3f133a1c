"""Connected components of a graph whose edges are rows of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours (with a partial aggregate before the
    shuffle, so a node with very many neighbours is no hot task), then follows the label's own label, which
    halves paths. Labels are written to the shared folder after each round. An empty edge table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        lower = materialize(lower, "lower")
        hop = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = materialize(lower.join(hop, "root").select("node", "before", F.least("root", "up").alias("root")), "labels")
        changed = after.filter("root <> before").limit(1).count()
        discard(lower)
        discard(labels)
        labels = after.select("node", "root")
        if not changed:
            discard(both)
            return labels
