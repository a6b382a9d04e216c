"""Connected components of a table of links, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of `links` (a, b): comp is the smallest node it can reach.

    Each round a node takes the smallest label of its neighbours, then the label of its label, so that long chains
    shorten by half at least; every round is a written table. Links are few beside documents: one or a few per near copy.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        nearest = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(nearest, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        onward = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        moved = nearer.join(onward, "to").select("node", F.least("to", "next").alias("comp"), (F.least("to", "next") < F.col("was")).alias("moved"))
        table = written(moved, "labels")
        labels = table.select("node", "comp")
        if not table.filter("moved").limit(1).count():
            return labels
