"""Connected components by contraction: each round joins every node to its least neighbour and rewrites the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for all nodes of the edges (a, b): label is one node of the component, the same for all of it.

    A round's edges and labels are kept in the shared folder; nothing is gathered on the driver but a count. Hubs are
    aggregated before their shuffle, and rewritten edges made distinct, so the number of nodes falls at least by half a round.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    left = edges.count()
    if not left:
        return labels
    labels = durable(labels)
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("p"))
        up = parent.select(F.col("u").alias("pu"), F.col("p").alias("pp"))
        parent = durable(parent.join(up, F.col("p") == F.col("pu")).select("u", F.least("p", "pp").alias("p")))
        labels = durable(labels.join(parent, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label")))
        to = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        edges = edges.join(parent, F.col("a") == F.col("u")).join(to, F.col("b") == F.col("v"))
        edges = durable(edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct())
        left = edges.count()
    return labels
