"""Connected components by alternating large-star and small-star steps over an edge table, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a long, b long) that isn't its own component's smallest.

    Loops, nulls and repeated edges are ignored; an empty table gives an empty one. Every round is two aggregations
    with joins on node; partial minima keep a node of very many edges cheap, and the adaptive skew join splits it.
    Rounds grow with the logarithm of the longest chain.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == before or not stamp[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before, old = stamp, now
        now = written(_small_star(_large_star(old)), "edges")
        dropped(old)
    raise RuntimeError("components did not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than the node is tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), "b")).distinct()
