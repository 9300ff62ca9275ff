"""Connected components of an edge list, by neighbour minima and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); ``root`` is the smallest node of its component.

    Labels only fall, so the rounds end. Each halves the distance to the root at least along paths of smallest labels, and its table is
    written to the shared folder, so lineage stays short; the table of the round before is deleted. Nothing is collected but one count.
    The rows of a hub with very many edges meet one row of the other side of a plain join, which Spark splits when it is skewed.
    Null ends make no edge; repeated edges and edges from a node to itself add nothing; no edges give no nodes.
    """
    both = staged(edges.select("a", "b").filter("a != b").distinct(), "edges")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    table = labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("via"))
        hop = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        moved = staged(nearer.join(hop, "via").select("node", "was", F.least("via", "far").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("was != root").isEmpty():
            return labels
        drop(edges.sparkSession, table)
        table = moved
