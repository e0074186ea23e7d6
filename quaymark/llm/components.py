"""Connected components of an edge table, by minimum labels and pointer jumping, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.shared import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for all nodes of the edges a, b.

    A round takes the least label among a node's neighbours and then its label's label, so paths shorten by halves. Nodes
    of any degree are aggregated before the shuffle and joined with splitting of skewed keys; no neighbourhood is gathered.
    Each round's labels are a written table, which cuts the lineage.
    """
    pairs = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Each node keeps the edge to its least neighbour, and its other neighbours are joined to that one: equal edges between hubs fall together.
    low = pairs.groupBy("a").agg(F.min("b").alias("p"))
    thin = pairs.join(low, "a").select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b"))
    pairs, first = written(thin.distinct(), "edges"), pairs
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    labels_at = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at_"), F.col("label").alias("next"))
        new = written(lower.join(jump, F.col("label") == F.col("at_"), "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        discard(labels_at)
        labels, labels_at = new.select("node", "label"), new
        if new.where(F.col("old") != F.col("label")).isEmpty():
            discard(first, pairs, both)
            return labels
