"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of links (a, b); self-links only name their node.

    Each round halves distances at least; a node's neighbours are only ever reduced to their minimum
    in partial sums, or joined with it in a join whose skew Spark can split.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = written(small, "edges", 2 * n)
        m = new.count()
        same = m == n and new.join(edges, ["a", "b"], "left_anti").isEmpty()  # tables of distinct rows
        forget(edges)
        edges, n = new, m
        if same:
            break
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
