"""Connected components of a distributed edge list by alternating large and small stars.

Every round is two shuffled minimum aggregations, each joined back to the edges:
no adjacency list is ever gathered, so a hub with a third of all edges is
pre-aggregated before its shuffle and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    # here every edge already points from a larger to a smaller node
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs, self-loops and repeats allowed, to (node, component).

    ``component`` is the smallest node reachable.  Nodes that are their own component
    and nothing else's do not appear.  Null ends are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = checkpointed(edges.distinct())
    before = None
    while True:
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        edges = checkpointed(_small_star(_large_star(edges)).distinct())
